"""Betweenness of a single source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loop import by, cut
from .traversal import sssp

TOLERANCE = 1e-9


def bc(graph: Graph, source: int = 0) -> DataFrame:
    """vertex and centrality: the dependency of source on each vertex it reaches, by weighted shortest paths; weights must be positive.

    Parallel edges are different paths. Path counts go down the graph of
    shortest paths hop by hop, dependencies up it; each round joins only what
    the previous one delivered.
    """
    far = cut(sssp(graph, source).filter("distance is not null").select("vertex", "distance"))
    ends = graph.edges.join(far.toDF("src", "_ds"), "src").join(far.toDF("dst", "_dd"), "dst")
    dag = cut(ends.filter((F.abs(F.col("_ds") + F.col("weight") - F.col("_dd")) <= TOLERANCE) & (F.col("src") != F.col("dst"))).select("src", "dst"))
    down, up = by(dag, "src"), by(dag.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "src")

    def totals(edges: DataFrame, start: DataFrame) -> DataFrame | None:
        """Of each vertex, the sum of all that ever arrives."""
        wave, every = start, None
        while True:
            wave = cut(edges.join(wave.withColumnRenamed("vertex", "src"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.sum("x").alias("x")))
            if wave.isEmpty():
                return every
            every = wave if every is None else cut(every.unionByName(wave).groupBy("vertex").agg(F.sum("x").alias("x")))

    root = far.filter(F.col("vertex") == source).select("vertex", F.lit(1.0).alias("x"))
    found = totals(down, root)
    sigma = cut(root.unionByName(found) if found is not None else root).withColumnRenamed("x", "sigma")
    back = totals(up, sigma.select("vertex", (1 / F.col("sigma")).alias("x")))
    out = sigma if back is None else sigma.join(back, "vertex", "left")
    value = F.lit(0.0) if back is None else F.col("sigma") * F.coalesce("x", F.lit(0.0))
    return out.select("vertex", value.alias("centrality"))


def bc_best(scores: DataFrame, source: int = 0) -> DataFrame:
    """vertex and centrality of the most central vertex other than source; of equals the least."""
    return scores.filter(F.col("vertex") != source).orderBy(F.desc("centrality"), "vertex").limit(1)
