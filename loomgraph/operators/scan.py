"""Operators of one pass over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def degree_cnt(graph: Graph) -> DataFrame:
    """vertex and out-degree of all vertices."""
    return graph.vertices.withColumnRenamed("id", "vertex").join(graph.out_degrees(), "vertex", "left").select("vertex", F.coalesce("degree", F.lit(0)).alias("degree"))


def conductance(graph: Graph) -> DataFrame:
    """value: edges between odd and even vertices, over the greater number of edges that leave either; null without edges."""
    odd = F.count_if(F.pmod("src", F.lit(2)) == 1)
    cross = F.count_if(F.pmod("src", F.lit(2)) != F.pmod("dst", F.lit(2)))
    return graph.edges.agg(F.try_divide(cross, F.greatest(odd, F.count(F.lit(1)) - odd)).alias("value"))


def bad_edges(graph: Graph) -> DataFrame:
    """The edges with an end outside the vertex domain."""
    v = graph.num_vertices
    return graph.edges.filter((F.greatest("src", "dst") >= v) | (F.least("src", "dst") < 0))


def range_check(graph: Graph, fail: bool = False) -> DataFrame:
    """bad_edges: their number; with fail, a ValueError if there are any."""
    out = bad_edges(graph).agg(F.count(F.lit(1)).alias("bad_edges"))
    if fail and (n := out.first().bad_edges):
        raise ValueError(f"{n} edges leave the domain of {graph.num_vertices} vertices")
    return out


def reverse(graph: Graph) -> DataFrame:
    """src, dst and weight with the ends swapped."""
    return graph.reverse().edges


def spmv(graph: Graph, x: DataFrame | None = None) -> DataFrame:
    """vertex and value: the row vector x times the matrix of (src, dst, weight); 0 in empty columns. x (id, x) is each id by default."""
    edges = graph.edges
    terms = edges.withColumn("_x", F.col("src").cast("double")) if x is None else edges.join(x.select(F.col("id").alias("src"), F.col("x").alias("_x")), "src")
    y = terms.groupBy(F.col("dst").alias("vertex")).agg(F.sum(F.col("weight") * F.col("_x")).alias("value"))
    return graph.vertices.withColumnRenamed("id", "vertex").join(y, "vertex", "left").select("vertex", F.coalesce("value", F.lit(0.0)).alias("value"))


def checkbip(graph: Graph) -> DataFrame:
    """is_bipartite: no vertex has both a greater and a smaller out-neighbour, and there is no loop (the convention of rating files: left ids are smaller)."""
    sides = graph.edges.groupBy("src").agg(F.bool_or(F.col("src") < F.col("dst")).alias("up"), F.bool_or(F.col("src") > F.col("dst")).alias("down"), F.bool_or(F.col("src") == F.col("dst")).alias("loop"))
    return sides.agg((~F.coalesce(F.bool_or((F.col("up") & F.col("down")) | F.col("loop")), F.lit(False))).alias("is_bipartite"))


def sort_edges(graph: Graph) -> DataFrame:
    """The edges in order of src, then dst: range-partitioned, each part sorted."""
    return graph.edges.orderBy("src", "dst")
