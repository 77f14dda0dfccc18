"""The data model: a dense vertex domain and a DataFrame of directed edges."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "src long, dst long, weight double"


@dataclass(frozen=True)
class Graph:
    """Edges (src, dst, weight) over the vertices 0 to num_vertices - 1.

    Vertices without edges exist. Loops and parallel edges stay unless an
    operator says otherwise. weight is null in an unweighted graph.
    """

    edges: DataFrame
    num_vertices: int

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def vertices(self) -> DataFrame:
        return self.spark.range(self.num_vertices)

    def reverse(self) -> Graph:
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def both_ways(self) -> Graph:
        """Each edge and its reverse, with the same weight."""
        ends = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "weight") for a, b in (("src", "dst"), ("dst", "src"))]
        return replace(self, edges=self.edges.select(F.inline(F.array(*ends))))

    def simple(self) -> Graph:
        """Undirected without loops and parallel edges: both directions of each pair, with its least weight."""
        pair = self.pairs()
        return replace(self, edges=pair.unionByName(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))

    def pairs(self) -> DataFrame:
        """One row (lower id, higher id, least weight) for each pair of linked vertices."""
        low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
        return self.edges.filter("src <> dst").select(low, high, "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight"))

    def out_degrees(self) -> DataFrame:
        """vertex and degree of the vertices that have out-edges."""
        return self.edges.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))


def from_edges(edges: DataFrame, num_vertices: int) -> Graph:
    """A graph of any DataFrame with src and dst, and weight if it has one."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(None).cast("double")
    return Graph(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight")), num_vertices)
