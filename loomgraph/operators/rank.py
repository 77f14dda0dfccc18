"""PageRank and its delta form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loop import Dealt, by, cut

DAMPING = 0.85


def _shares(graph: Graph) -> DataFrame:
    """src, dst and the share of src's rank that goes there; parallel edges in one row, so each round shuffles a row for each pair at most."""
    pairs = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(graph.out_degrees().withColumnRenamed("vertex", "src"), "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("share"))


def pagerank(graph: Graph, niters: int = 5) -> DataFrame:
    """vertex and rank: r0 = 1, then 0.15 + 0.85 times the shares received, niters times; not normalised, and nothing is given back by sinks."""
    edges = Dealt(_shares(graph))
    rank = by(graph.vertices.select("id", F.lit(1.0).alias("rank")), "id")
    for k in range(niters):
        got = edges.met(rank.withColumnRenamed("id", "src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("_got"))
        rank = rank.select("id").join(got, "id", "left").select("id", (F.lit(1 - DAMPING) + DAMPING * F.coalesce("_got", F.lit(0.0))).alias("rank"))
        if k % 4 == 3 and k + 1 < niters:
            rank = cut(rank)
    return rank.withColumnRenamed("id", "vertex")


def pagerank_ddf(graph: Graph, niters: int = 5, threshold: float = 0.5) -> DataFrame:
    """vertex, rank and delta: a vertex whose delta over its out-degree is above the threshold hands it on and adds it to its rank.

    At most niters rounds; what the last one delivered stays in delta.
    """
    edges = Dealt(_shares(graph))
    degrees = graph.out_degrees().withColumnRenamed("vertex", "id")
    state = by(graph.vertices.join(degrees, "id", "left").select("id", F.lit(1 - DAMPING).alias("rank"), F.lit(1.0).alias("delta"), F.coalesce("degree", F.lit(0)).alias("degree")), "id")
    for _ in range(niters):
        pushes = (F.col("degree") > 0) & (F.try_divide("delta", "degree") > threshold)
        marked = state.withColumn("_push", F.coalesce(pushes, F.lit(False)))
        sent = edges.met(marked.filter("_push").select(F.col("id").alias("src"), "delta")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("delta") * F.col("share")).alias("_got"))
        new = marked.join(sent, "id", "left").select(
            "id",
            F.when(F.col("_push"), F.col("rank") + F.col("delta")).otherwise(F.col("rank")).alias("rank"),
            (F.when(F.col("_push"), F.lit(0.0)).otherwise(F.col("delta")) + DAMPING * F.coalesce("_got", F.lit(0.0))).alias("delta"),
            "degree",
            "_push",
        )
        new = cut(new)
        state = new.drop("_push")
        if new.filter("_push").isEmpty():
            break
    return state.select(F.col("id").alias("vertex"), "rank", "delta")
