"""Vertex programs: scatter, gather and apply as Spark column expressions.

A superstep is one plan: the active vertices' rows meet the edges, `emit`
filters and `messages` shapes what goes to the other end, `gather` aggregates
it by destination (Spark combines before the shuffle), and `apply` folds it
into the state. All of it is Catalyst's; nothing is called for each vertex.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .loop import Dealt, NotConverged, by, cut


@dataclass(frozen=True)
class VertexProgram:
    """State columns and how they change.

    init: state columns over `id`. messages: columns over `src`, `dst`,
    `weight` and the source's state. gather: aggregates over the messages.
    apply: new state over the old state, and the gathered columns (null where
    no message came). active: over the new state, the old as `old_<name>` and
    the gathered columns; whether the vertex scatters next. starts: over the
    first state. A step is given to init, apply and active as the column `step`.
    """

    init: dict[str, Column]
    messages: dict[str, Column]
    gather: dict[str, Column]
    apply: dict[str, Column]
    active: Column
    starts: Column = field(default_factory=lambda: F.lit(True))
    emit: Column | None = None
    max_steps: int = 1 << 20
    fixed_steps: int | None = None
    strict: bool = True
    counters: dict[str, Column] = field(default_factory=dict)


@dataclass
class Run:
    state: DataFrame
    steps: int
    counters: list[dict]


def run(graph: Graph, program: VertexProgram, on_step: Callable[[int, DataFrame], None] | None = None) -> Run:
    """The state after the last superstep: no vertex active, or the fixed number done.

    Raises NotConverged when max_steps are done with vertices active and
    `strict` is set.
    """
    p = program
    edges = Dealt(graph.edges)
    state = graph.vertices.select("id", *(c.alias(k) for k, c in p.init.items()))
    state = by(state.withColumn("_active", p.starts), "id")
    counted: list[dict] = []
    steps, last = 0, p.fixed_steps if p.fixed_steps is not None else p.max_steps
    while steps < last:
        steps += 1
        sent = edges.met(state.filter("_active").drop("_active").withColumnRenamed("id", "src"))
        if p.emit is not None:
            sent = sent.filter(p.emit)
        inbox = sent.select("dst", *(c.alias(k) for k, c in p.messages.items())).groupBy("dst").agg(*(c.alias(k) for k, c in p.gather.items()))
        met = state.drop("_active").join(inbox.withColumnRenamed("dst", "id"), "id", "left").withColumn("step", F.lit(steps))
        old = met.withColumns({f"old_{k}": F.col(k) for k in p.init})
        new = old.withColumns({k: c for k, c in p.apply.items()})
        state = cut(new.select("id", *p.init, F.coalesce(p.active, F.lit(False)).alias("_active")))
        row = state.agg(F.count_if("_active").alias("active"), *(c.alias(k) for k, c in p.counters.items())).first()
        counted.append(row.asDict())
        if on_step:
            on_step(steps, state)
        if p.fixed_steps is None and not row.active:
            return Run(state.drop("_active"), steps, counted)
    if p.fixed_steps is None and p.strict:
        raise NotConverged(f"vertices are active after {steps} supersteps")
    return Run(state.drop("_active"), steps, counted)
