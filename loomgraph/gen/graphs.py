"""Random graphs, each edge a function of its number and the seed: the same for any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) by a hash of the seed and the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def _below(n: int, seed: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n))


def rmat(spark: SparkSession, scale: int = 16, num_edges: int = 1 << 20, a: float = 0.57, b: float = 0.19, c: float = 0.19, noise: float = 0.05, symmetric: bool = False, seed: int = 1) -> Graph:
    """2^scale vertices; each edge descends through quadrants with probabilities a, b, c and the rest, which each level shifts by up to `noise` of themselves; weights are uniform."""
    e = F.col("id")

    def level(acc: Column, i: Column) -> Column:
        shift = lambda p, k: p * (1 - noise + 2 * noise * uniform(seed, e, i, F.lit(k)))
        pa, pb, pc, pd = shift(a, 1), shift(b, 2), shift(c, 3), shift(1 - a - b - c, 4)
        u = uniform(seed, e, i, F.lit(0)) * (pa + pb + pc + pd)
        low, right = u >= pa + pb, ((u >= pa) & (u < pa + pb)) | (u >= pa + pb + pc)
        return F.struct((acc["src"] * 2 + low.cast("long")).alias("src"), (acc["dst"] * 2 + right.cast("long")).alias("dst"))

    zero = F.struct(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"))
    drawn = spark.range(num_edges).select("id", F.aggregate(F.sequence(F.lit(1), F.lit(scale)), zero, level).alias("e"))
    g = Graph(drawn.select("e.src", "e.dst", uniform(seed, e, F.lit(-1)).alias("weight")), 1 << scale)
    return g.both_ways() if symmetric else g


def erdos_renyi(spark: SparkSession, num_vertices: int = 1 << 16, num_edges: int = 1 << 20, self_loops: bool = False, symmetric: bool = False, seed: int = 1) -> Graph:
    """Ends drawn evenly; without loops the second end is one of the other vertices."""
    e, v = F.col("id"), num_vertices
    src = _below(v, seed, e, F.lit(0))
    dst = _below(v, seed, e, F.lit(1)) if self_loops else F.pmod(src + 1 + _below(max(1, v - 1), seed, e, F.lit(1)), F.lit(v))
    g = Graph(spark.range(num_edges).select(src.alias("src"), dst.alias("dst"), uniform(seed, e, F.lit(2)).alias("weight")), v)
    return g.both_ways() if symmetric else g


def bipartite(spark: SparkSession, left: int, right: int, num_edges: int, symmetric: bool = False, seed: int = 1) -> Graph:
    """From one of the first `left` vertices to one of the `right` after them."""
    e = F.col("id")
    g = Graph(spark.range(num_edges).select(_below(left, seed, e, F.lit(0)).alias("src"), (_below(right, seed, e, F.lit(1)) + left).alias("dst"), uniform(seed, e, F.lit(2)).alias("weight")), left + right)
    return g.both_ways() if symmetric else g
