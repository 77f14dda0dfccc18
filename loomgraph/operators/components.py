"""Connected and strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loop import Dealt, by, cut


def least_reaching(edges: Dealt, labels: DataFrame) -> DataFrame:
    """labels (id, component) lowered along edges until nothing changes.

    The component becomes the least label that reaches a vertex. Where a label
    is a vertex's id, its own label is taken too (a label reaches what its
    label reaches), which halves long chains. Only edges from changed vertices
    are joined.
    """
    state = cut(labels.withColumn("_active", F.lit(True)))
    while True:
        sent = edges.met(state.filter("_active").select(F.col("id").alias("src"), F.col("component").alias("_c"))).groupBy(F.col("dst").alias("id")).agg(F.min("_c").alias("_best"))
        lower = state.select("id", "component").join(sent, "id", "left").withColumn("_low", F.least("component", "_best"))
        jump = state.select(F.col("id").alias("_low"), F.col("component").alias("_jump"))
        new = lower.join(jump, "_low", "left").select("id", F.least("_low", "_jump").alias("_new"), "component")
        state = cut(new.select("id", F.col("_new").alias("component"), (F.col("_new") < F.col("component")).alias("_active")).repartition("id"))
        if state.filter("_active").isEmpty():
            return state.drop("_active")


def cc(graph: Graph, symmetrize: bool = False) -> DataFrame:
    """vertex and component, the least vertex that reaches it; on a symmetric graph (or with symmetrize) the connected component."""
    g = graph.both_ways() if symmetrize else graph
    edges = Dealt(g.edges.filter("src <> dst").select("src", "dst"), distinct=True)
    return least_reaching(edges, g.vertices.select("id", F.col("id").alias("component"))).withColumnRenamed("id", "vertex")


def cc_count(labels: DataFrame) -> DataFrame:
    """cc_count: vertices that kept their own label; on symmetric input the number of components."""
    return labels.agg(F.count_if(F.col("vertex") == F.col("component")).alias("cc_count"))


def scc(graph: Graph) -> DataFrame:
    """vertex and component, the least vertex of its strongly connected component.

    A round colours each open vertex with the least open vertex that reaches
    it; the vertices that reach their colour's vertex within the colour are
    its component. What is settled leaves, with all edges between colours. An
    edge to a vertex without open in- or out-edges can lie on no cycle, so such
    vertices settle as themselves first.
    """
    open_edges = cut(graph.edges.filter("src <> dst").select("src", "dst").distinct())
    settled = None
    while True:
        live = cut(open_edges.select(F.col("src").alias("id")).distinct().join(open_edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi"))
        if live.isEmpty():
            break
        trimmed = cut(open_edges.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        if trimmed.count() < open_edges.count():
            open_edges = trimmed
            continue
        edges = Dealt(open_edges)
        colour = least_reaching(edges, live.select("id", F.col("id").alias("component")))
        a, b = colour.toDF("src", "_a"), colour.toDF("dst", "_b")
        same = cut(edges.met(a).join(b, "dst").filter("_a = _b").select("src", "dst", F.col("_a").alias("colour")))
        back = by(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "src")
        reached = cut(colour.filter("id = component"))
        frontier = reached
        while not frontier.isEmpty():
            step = back.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "component").distinct()
            frontier = cut(step.join(reached.select("id"), "id", "left_anti"))
            reached = cut(reached.unionByName(frontier))
        settled = reached if settled is None else cut(settled.unionByName(reached))
        gone = reached.select("id")
        open_edges = cut(same.select("src", "dst").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    v = graph.vertices
    if settled is None:
        return v.select(F.col("id").alias("vertex"), F.col("id").alias("component"))
    return v.join(settled, "id", "left").select(F.col("id").alias("vertex"), F.coalesce("component", "id").alias("component"))


def scc_count(labels: DataFrame) -> DataFrame:
    """scc_count: the number of components."""
    return labels.agg(F.count_if(F.col("vertex") == F.col("component")).alias("scc_count"))
