"""Neighbourhood functions: how many vertices lie within t hops."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loop import Dealt, by, cut, drop

Series = list[tuple[int, float]]


def _frame(graph: Graph, series: Series, seed: tuple[int, float] | None, kind: str) -> DataFrame:
    out = graph.spark.createDataFrame([(t, int(n) if kind == "long" else float(n)) for t, n in series], f"t long, n {kind}")
    return out.withColumns({"seed": F.lit(seed[0] if seed else None).cast("long"), "seed_reach": F.lit(seed[1] if seed else None).cast("double")})


#: Bytes of the bit sets of a block of sources, the most sources in one, tasks that share the blocks, edges in a row of bytes, and edges met at once.
BLOCK, SOURCES, TASKS, PACK, STEP = 1 << 27, 1 << 12, 64, 1 << 16, 1 << 12


def _packed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) as rows of compressed bytes, each of many edges in order of dst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                src, dst = (batch.column(c).to_numpy()[at : at + PACK] for c in (0, 1))
                order = np.lexsort((src, dst))
                both = np.stack([src[order], np.diff(dst[order], prepend=0)])
                wide = both.min() < 0 or both.max() >= 1 << 32
                part = both.astype("<i8" if wide else "<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([wide]), pa.array([zlib.compress(part, 1)], pa.binary())], ["wide", "part"])

    return edges.mapInArrow(run, "wide boolean, part binary")


def _spread(old: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """old with the rows at src united into those at dst, which is sorted."""
    new = old.copy()
    for at in range(0, len(src), STEP):
        d = dst[at : at + STEP]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        new[d[first]] |= np.bitwise_or.reduceat(old[src[at : at + STEP]], first, axis=0)
    return new


def _reached(graph: Graph, maxiters: int) -> tuple[Series, tuple[int, int] | None]:
    """The whole series up to maxiters, and the seed with its reach at the end.

    Sources are taken in blocks, which don't meet: a task has the edges, and a
    bit for each vertex and source of one block at a time. Pairs are only counted, never
    written, so what moves is the edges, once a task, and a count a vertex.
    """
    v, block = graph.num_vertices, max(64, min(SOURCES, BLOCK * 8 // max(1, graph.num_vertices) // 64 * 64))
    tasks = max(1, min(TASKS, -(-v // block)))

    def count(table: pa.Table) -> pa.Table:
        task = table.column("task")[0].as_py()
        parts = [np.frombuffer(zlib.decompress(x), "<i8" if w else "<u4").astype(np.int64).reshape(2, -1) for w, x in zip(table.column("wide").to_pylist(), table.column("part").to_pylist(), strict=True) if x is not None]
        src = np.concatenate([x[0] for x in parts] or [np.zeros(0, np.int64)])
        dst = np.concatenate([np.cumsum(x[1]) for x in parts] or [np.zeros(0, np.int64)])
        del parts, table
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        n = max(v, int(src.max(initial=-1)) + 1, int(dst.max(initial=-1)) + 1)
        reach, found = np.zeros(n, np.int64), [0] * maxiters
        for first in range(task * block, v, tasks * block):
            ids = np.arange(first, min(first + block, v))
            old = np.zeros((n, -(-len(ids) // 64)), np.uint64)
            old[ids, (ids - first) // 64] = np.uint64(1) << ((ids - first) % 64).astype(np.uint64)
            known, changed = np.bitwise_count(old).sum(1, dtype=np.int64), np.ones(n, bool)
            for t in range(1, maxiters):
                live = changed[src] & (known[src] > 0) & (known[dst] < len(ids))
                old = _spread(old, src[live], dst[live])
                now = np.bitwise_count(old).sum(1, dtype=np.int64)
                changed, more, known = now > known, int((now - known).sum()), now
                if not more:
                    break
                found[t] += more
            reach += known
        some, hops = np.flatnonzero(reach), np.flatnonzero(found)
        key = np.concatenate([some, hops])
        return pa.table({"hop": np.arange(len(key)) >= len(some), "key": key, "n": np.concatenate([reach[some], np.array(found, np.int64)[hops]])})

    edges = graph.edges.filter("src <> dst").select("src", "dst").distinct()
    each = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    sent = _packed(edges).select("wide", "part", each).unionByName(graph.spark.range(1).select(F.lit(None).cast("boolean").alias("wide"), F.lit(None).cast("binary").alias("part"), each))
    counts = sent.repartition(4 * tasks, "task").groupBy("task").applyInArrow(count, "hop boolean, key long, n long")
    summed = cut(counts.groupBy("hop", "key").agg(F.sum("n").alias("n")))
    n = v
    series: Series = [(0, n)]
    for r in summed.filter("hop").orderBy("key").collect():
        n += r.n
        series.append((r.key, n))
    best = summed.filter("not hop").orderBy(F.desc("n"), "key").first()
    return series, (best.key, best.n) if best else None


def hyperanf_exact(graph: Graph, maxiters: int = 100, epsilon: float = 0.001, run_to_completion: bool = False) -> DataFrame:
    """t and n: the sum over vertices of the vertices that reach them in t hops or fewer, themselves included; also the seed, the vertex that most reach, and how many do."""
    series, seed = _reached(graph, maxiters)
    for (_, before), (t, n) in zip(series, series[1:]):
        if not run_to_completion and n - before < epsilon * n and t < series[-1][0]:
            series, seed = _reached(graph, t + 1)  # the seed's reach is that of the last round
            break
    return _frame(graph, series, seed, "long")


def registers(rsd: float) -> int:
    """Log2 of the registers for a relative standard deviation."""
    return max(4, min(21, math.ceil(math.log2((1.106 / rsd) ** 2))))


def hyperanf(graph: Graph, maxiters: int = 100, epsilon: float = 0.001, rsd: float = 0.10, run_to_completion: bool = False) -> DataFrame:
    """The same estimated by a sketch of each vertex's ball, united along the edges; only changed sketches are sent."""
    k = registers(rsd)
    edges = Dealt(graph.edges.filter("src <> dst").select("src", "dst").distinct())
    state = by(graph.vertices.groupBy("id").agg(F.hll_sketch_agg("id", F.lit(k)).alias("ball")).withColumn("_active", F.lit(True)), "id")
    total = lambda: state.agg(F.sum(F.hll_sketch_estimate("ball"))).first()[0] or 0
    n = total()
    series: Series = [(0, n)]
    for t in range(1, maxiters):
        got = edges.met(state.filter("_active").select(F.col("id").alias("src"), "ball")).groupBy(F.col("dst").alias("id")).agg(F.hll_union_agg("ball").alias("_got"))
        met = state.select("id", "ball").join(got, "id", "left")
        new = F.when(F.col("_got").isNull(), F.col("ball")).otherwise(F.hll_union("ball", "_got"))
        grown = met.withColumn("_new", new)
        last, state = state, cut(grown.select("id", F.col("_new").alias("ball"), (F.hll_sketch_estimate("_new") > F.hll_sketch_estimate("ball")).alias("_active")))
        drop(last)
        before, n = n, total()
        if n == before:
            break
        series.append((t, n))
        if not run_to_completion and n - before < epsilon * n:
            break
    best = state.select("id", F.hll_sketch_estimate("ball").alias("n")).orderBy(F.desc("n"), "id").first()
    return _frame(graph, series, (best.id, best.n) if best else None, "double")
