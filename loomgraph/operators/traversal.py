"""Breadth-first search, shortest paths, and their forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loop import Dealt, NotConverged, by, cut
from ..plans.program import VertexProgram, run



def bfs(graph: Graph, root: int = 0) -> DataFrame:
    """vertex, level and parent of every vertex reached from root; the parent is the least of the previous level.

    A root outside the graph reaches nothing. Each level joins the edges with
    its frontier only, and drops what was visited.
    """
    edges = Dealt(graph.edges.select("src", "dst"))
    visited = by(graph.vertices.filter(F.col("id") == root).select(F.col("id").alias("vertex"), F.lit(0).cast("long").alias("level"), F.col("id").alias("parent")), "vertex")
    level = 0
    while True:
        frontier = visited.filter(F.col("level") == level).select(F.col("vertex").alias("src"))
        reached = edges.met(frontier).groupBy(F.col("dst").alias("vertex")).agg(F.min("src").alias("parent"))
        level += 1
        new = cut(reached.join(visited.select("vertex"), "vertex", "left_anti").select("vertex", F.lit(level).cast("long").alias("level"), "parent"))
        if new.isEmpty():
            return visited
        visited = cut(visited.unionByName(new).repartition("vertex")) if level % 8 == 0 else visited.unionByName(new)


def bfs_counters(graph: Graph, reached: DataFrame) -> DataFrame:
    """vertices_discovered (without the root) and edges_explored (out-edges of all that was reached) of a bfs."""
    explored = reached.join(graph.out_degrees(), "vertex", "left")
    return explored.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("vertices_discovered"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges_explored"))


def bfs_forest(graph: Graph) -> DataFrame:
    """vertex, component (the least vertex that reaches it), parent and level (the round of its last change)."""
    zero = F.lit(0).cast("long")
    better = F.coalesce(F.col("best.component") < F.col("component"), F.lit(False))
    program = VertexProgram(
        init={"component": F.col("id"), "parent": F.col("id"), "level": zero},
        messages={"component": F.col("component"), "from": F.col("src")},
        gather={"best": F.min(F.struct("component", "from"))},
        apply={
            "component": F.when(better, F.col("best.component")).otherwise(F.col("component")),
            "parent": F.when(better, F.col("best.from")).otherwise(F.col("parent")),
            "level": F.when(better, F.col("step").cast("long")).otherwise(F.col("level")),
        },
        active=F.col("component") < F.col("old_component"),
    )
    return run(graph, program).state.withColumnRenamed("id", "vertex")


def _predecessors(graph: Graph, state: DataFrame, *same: str) -> DataFrame:
    """The least source of an edge that attains each vertex's distance."""
    at = state.select("id", "distance", *same)
    ends = graph.edges.join(at.select(F.col("id").alias("src"), F.col("distance").alias("_d"), *(F.col(c).alias(f"_{c}") for c in same)), "src")
    met = ends.join(at.withColumnRenamed("id", "dst"), "dst").filter((F.col("_d") + F.col("weight") == F.col("distance")) & (F.col("src") != F.col("dst")) & (F.col("weight") > 0))
    for c in same:
        met = met.filter(F.col(c) == F.col(f"_{c}"))
    return met.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("predecessor"))


def sssp(graph: Graph, source: int = 0, max_rounds: int | None = None) -> DataFrame:
    """vertex, distance and predecessor of all vertices; both null where source reaches nothing.

    Rounds relax the edges of what changed. A negative cycle never settles:
    after max_rounds, by default as many as there are vertices, NotConverged
    is raised.
    """
    inf = F.lit(float("inf"))
    program = VertexProgram(
        init={"distance": F.when(F.col("id") == source, F.lit(0.0)).otherwise(inf)},
        starts=F.col("id") == source,
        messages={"d": F.col("distance") + F.col("weight")},
        gather={"best": F.min("d")},
        apply={"distance": F.least("distance", "best")},
        active=F.col("distance") < F.col("old_distance"),
        max_steps=max_rounds or max(2, graph.num_vertices + 1),
    )
    state = run(graph, program).state
    state = state.join(_predecessors(graph, state.filter(F.col("distance") < inf)), "id", "left")
    return state.select(F.col("id").alias("vertex"), F.when(F.col("distance") < inf, F.col("distance")).alias("distance"), F.when(F.col("id") != source, F.col("predecessor")).alias("predecessor"))


def sssp_forest(graph: Graph, max_rounds: int | None = None) -> DataFrame:
    """vertex, component (the least vertex that reaches it), distance from that, and predecessor."""
    better = F.coalesce(F.col("best") < F.struct(F.col("component"), F.col("distance").alias("d")), F.lit(False))
    program = VertexProgram(
        init={"component": F.col("id"), "distance": F.lit(0.0)},
        messages={"component": F.col("component"), "d": F.col("distance") + F.col("weight")},
        gather={"best": F.min(F.struct("component", "d"))},
        apply={"component": F.when(better, F.col("best.component")).otherwise(F.col("component")), "distance": F.when(better, F.col("best.d")).otherwise(F.col("distance"))},
        active=(F.col("component") != F.col("old_component")) | (F.col("distance") != F.col("old_distance")),
        max_steps=max_rounds or max(2, graph.num_vertices + 1),
    )
    state = run(graph, program).state
    out = state.join(_predecessors(graph, state, "component"), "id", "left")
    return out.select(F.col("id").alias("vertex"), "component", "distance", F.when(F.col("component") != F.col("id"), F.col("predecessor")).alias("predecessor"))


__all__ = ["NotConverged", "bfs", "bfs_counters", "bfs_forest", "sssp", "sssp_forest"]
