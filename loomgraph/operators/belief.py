"""Belief propagation over edges with two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loop import cut

#: Fixed values of the vertex form: priors of good, bad and other vertices, state potentials, and the limits of messages and beliefs.
GOOD, BAD, OTHER = 0.05, 0.95, 0.5
PHI = ((0.95, 0.05), (0.5, 0.5))
LEAST, MOST = 1e-4, 0.9999


def belief_propagation(graph: Graph, niters: int = 5, potential: tuple[tuple[float, float], tuple[float, float]] | None = None) -> DataFrame:
    """src, dst, b0 and b1 of each edge and of its reverse, after niters - 1 rounds (the first of niters reads nothing).

    Each starts with its weight as both beliefs. In a round an edge is answered
    by one back, with the product of all beliefs at its end over its own. The
    potential is the weight where the answer goes to a higher id, else what it
    lacks to 1; a matrix by state replaces one half of it.
    """
    m = potential or ((0.5, 0.5), (0.5, 0.5))
    w = F.col("weight")
    base = graph.edges.select("src", "dst", w.alias("b0"), w.alias("b1"), w.alias("up"), (1 - w).alias("down"))
    state = cut(base.unionByName(base.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "b0", "b1", "up", "down")))
    for _ in range(max(0, niters - 1)):
        product = state.groupBy("dst").agg(F.product("b0").alias("p0"), F.product("b1").alias("p1"))
        pot = F.when(F.col("dst") < F.col("src"), F.col("up")).otherwise(F.col("down"))
        rest0, rest1 = F.try_divide("p0", "b0"), F.try_divide("p1", "b1")
        raw = [m[i][0] * pot * rest0 + m[i][1] * pot * rest1 for i in range(2)]
        answer = state.join(product, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), raw[0].alias("r0"), raw[1].alias("r1"), "up", "down")
        total = F.col("r0") + F.col("r1")
        state = cut(answer.select("src", "dst", *(F.when(total > 0, F.col(f"r{i}") / total).otherwise(F.col(f"r{i}")).alias(f"b{i}") for i in range(2)), "up", "down"))
    return state.select("src", "dst", "b0", "b1")


def prior(vertex: Column) -> Column:
    """By a fixed hash of the vertex: one in a hundred is good, one bad."""
    h = F.pmod((F.lit(17) + vertex) * F.lit(3428971), F.lit(100))
    return F.when(h == 0, F.lit(GOOD)).when(h == 1, F.lit(BAD)).otherwise(F.lit(OTHER))


def belief_propagation_graphchi(graph: Graph, niters: int = 5) -> DataFrame:
    """vertex and belief0 after niters - 1 rounds; the messages are sums of logarithms at each vertex, and seeds keep their prior."""
    v = cut(graph.vertices.select("id", prior(F.col("id")).alias("prior")))
    # each direction of an edge starts with the prior of its own source
    both = graph.edges.select("src", "dst").unionByName(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    state = cut(both.join(v.select(F.col("id").alias("src"), F.col("prior").alias("m")), "src"))
    beliefs = v.select("id", F.col("prior").alias("b0"))
    for _ in range(max(0, niters - 1)):
        logs = state.groupBy(F.col("dst").alias("id")).agg(F.sum(F.log("m")).alias("l0"), F.sum(F.log(1 - F.col("m"))).alias("l1"))
        met = v.join(logs, "id", "left").select("id", "prior", F.coalesce("l0", F.lit(0.0)).alias("l0"), F.coalesce("l1", F.lit(0.0)).alias("l1"))
        top = F.greatest("l0", "l1")
        r0 = F.greatest(F.col("prior") * F.exp(F.col("l0") - top), F.lit(LEAST))
        r1 = F.greatest((1 - F.col("prior")) * F.exp(F.col("l1") - top), F.lit(LEAST))
        beliefs = cut(met.select("id", F.when(F.col("prior") != OTHER, F.col("prior")).otherwise(r0 / (r0 + r1)).alias("b0")))
        m, b0, b1 = F.col("m"), F.col("b0"), 1 - F.col("b0")
        m0 = b0 * PHI[0][0] / m + b1 * PHI[1][0] / (1 - m)
        m1 = b0 * PHI[0][1] / m + b1 * PHI[1][1] / (1 - m)
        new = F.least(F.greatest(m0 / (m0 + m1), F.lit(LEAST)), F.lit(MOST))
        state = cut(state.join(beliefs.withColumnRenamed("id", "dst"), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), new.alias("m")))
    return beliefs.select(F.col("id").alias("vertex"), F.col("b0").alias("belief0"))
