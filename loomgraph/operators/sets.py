"""Maximal independent sets, spanning forests and triangles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loop import by, cut

#: Edges that a task of a grid holds of either kind, ends of paths looked up at once, and bytes of minima a task holds of either side.
HELD, AT_ONCE, MINIMA = 1 << 22, 1 << 20, 1 << 27


def mis(graph: Graph) -> DataFrame:
    """vertex and in_mis: the set that taking vertices in order of id yields, of a symmetric graph.

    A vertex is in when all smaller neighbours are out, and out when one is
    in. Each round settles all vertices for which that is known, and drops the
    edges to them.
    """
    edges = by(graph.edges.filter("src < dst").select("src", "dst").distinct(), "dst")
    decided = None
    open_ = cut(graph.vertices)
    while True:
        waits = edges.select(F.col("dst").alias("id")).distinct()
        inside = cut(open_.join(waits, "id", "left_anti"))
        outside = cut(edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct())
        new = inside.withColumn("in_mis", F.lit(True)).unionByName(outside.withColumn("in_mis", F.lit(False)))
        decided = cut(new if decided is None else decided.unionByName(new))
        gone = inside.unionByName(outside)
        open_ = cut(open_.join(gone, "id", "left_anti"))
        if open_.isEmpty():
            return decided.withColumnRenamed("id", "vertex")
        edges = cut(edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))


def mcst(graph: Graph) -> DataFrame:
    """src, dst (src < dst) and weight of the minimum spanning forest's edges, in original ids.

    Edges are ordered by weight, then lower, then higher id, so the forest is
    unique. Each round every component takes its least edge out; components
    that chose each other root the merger, and labels jump to their root.
    """
    edges = cut(graph.pairs().select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")))
    forest = None
    while not edges.isEmpty():
        key = F.struct("weight", "src", "dst")
        ends = edges.select(F.col("a").alias("c"), F.col("b").alias("other"), key.alias("e")).unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("other"), key.alias("e")))
        best = cut(ends.groupBy("c").agg(F.min(F.struct("e", "other")).alias("m")).select("c", "m.e", "m.other"))
        chosen = cut(best.select("e.src", "e.dst", "e.weight").distinct())
        forest = chosen if forest is None else forest.unionByName(chosen)
        back = best.select(F.col("c").alias("other"), F.col("other").alias("_back"))
        root = best.join(back, "other").select("c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("root"))
        root = cut(root)
        while True:
            up = root.select(F.col("c").alias("root"), F.col("root").alias("_up"))
            moved = cut(root.join(up, "root").select("c", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")))
            root = moved.drop("_moved")
            if moved.filter("_moved").isEmpty():
                break
        a, b = root.toDF("a", "_ra"), root.toDF("b", "_rb")
        joined = edges.join(a, "a").join(b, "b").filter("_ra <> _rb")
        edges = cut(joined.select("src", "dst", "weight", F.col("_ra").alias("a"), F.col("_rb").alias("b")))
    return forest if forest is not None else graph.spark.createDataFrame([], "src long, dst long, weight double")


def mcst_summary(graph: Graph, forest: DataFrame) -> DataFrame:
    """tree_edges, cc_count and weight of a forest."""
    return forest.agg(F.count(F.lit(1)).alias("tree_edges"), (F.lit(graph.num_vertices) - F.count(F.lit(1))).alias("cc_count"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))


def _oriented(graph: Graph) -> DataFrame:
    """a -> b of each undirected edge, from the end of lower degree: no vertex keeps more than about the square root of twice the edges."""
    pairs = cut(graph.pairs().select("src", "dst"))
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    both = pairs.join(degree.toDF("src", "_ds"), "src").join(degree.toDF("dst", "_dd"), "dst")
    up = F.struct("_ds", "src") < F.struct("_dd", "dst")
    return both.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))


def _block(column: str | Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts))


def _rows(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids in order; and where each one's list ends, and all lists, in that order."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    lists = table.column(column).combine_chunks().take(pa.array(order))
    return ids[order], lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten().to_numpy()


def _closed(held: pa.Table, asked: pa.Table) -> pa.Table:
    """vertex and triangles a -> b -> c, a -> c: b with its list in held, a with its list in asked."""
    out = lambda vertex, n: pa.table({"vertex": pa.array(vertex, pa.int64()), "n": pa.array(n, pa.int64())})
    if not held.num_rows or not asked.num_rows:
        return out([], [])
    mid, mid_at, ends = _rows(held, "to")
    low, low_at, all_b = _rows(asked, "to")
    row = np.repeat(np.arange(len(low)), np.diff(low_at))
    wide = int(max(ends.max(), all_b.max())) + 1
    keys = np.sort(row * wide + all_b)
    at = np.minimum(np.searchsorted(mid, all_b), len(mid) - 1)
    there = mid[at] == all_b
    row, at = row[there], at[there]
    sizes = mid_at[at + 1] - mid_at[at]
    upto = np.cumsum(sizes)
    n_low, n_mid, n_end, first = np.zeros(len(low), np.int64), np.zeros(len(mid), np.int64), np.zeros(len(keys), np.int64), 0
    while first < len(row):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + AT_ONCE, "right")))
        r, m, size = row[first:last], at[first:last], sizes[first:last]
        own = np.repeat(np.arange(len(r)), size)
        c = ends[np.repeat(mid_at[m] - np.cumsum(size) + size, size) + np.arange(len(own))]
        key = r[own] * wide + c
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[place] == key
        own = own[hit]
        np.add.at(n_low, r[own], 1)
        np.add.at(n_mid, m[own], 1)
        np.add.at(n_end, place[hit], 1)
        first = last
    vertex, n = np.concatenate([low, mid, keys % wide]), np.concatenate([n_low, n_mid, n_end])
    some = n > 0
    vertex, inverse = np.unique(vertex[some], return_inverse=True)
    total = np.zeros(len(vertex), np.int64)
    np.add.at(total, inverse, n[some])
    return out(vertex, total)


def triangles(graph: Graph) -> DataFrame:
    """vertex and triangles through it, exact; edges count as undirected, without loops and repeats.

    Lists of out-neighbours meet, not paths of two edges: a task holds the lists of a
    block of vertices, and a slice of the lists that name one of these. A list moves once
    for each block that it names, so at most once an edge of it.
    """
    lists = cut(_oriented(graph).groupBy("a").agg(F.collect_list("b").alias("to")).withColumnRenamed("a", "id"))
    edges = lists.agg(F.sum(F.size("to"))).first()[0] or 0
    parts = max(4, -(-edges // HELD))
    named = F.array_distinct(F.transform("to", lambda x: _block(x, parts)))
    moved = lists.agg(F.sum(F.size("to").cast("long") * F.size(named))).first()[0] or 0
    slices = max(4, -(-moved // (parts * HELD)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))
    deal = lambda df: df.repartition(4 * parts * slices, "block", "slice").groupBy("block", "slice")
    held = deal(lists.select("id", "to", _block("id", parts).alias("block"), every.alias("slice")))
    asked = deal(lists.select("id", "to", F.explode(named).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(slices)).alias("slice")))
    met = held.cogroup(asked).applyInArrow(_closed, "vertex long, n long")
    n = met.groupBy("vertex").agg(F.sum("n").alias("triangles"))
    return graph.vertices.withColumnRenamed("id", "vertex").join(n, "vertex", "left").select("vertex", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def triangles_total(counts: DataFrame) -> DataFrame:
    return counts.agg((F.sum("triangles") / 3).alias("triangles"))


def triangles_minhash(graph: Graph, niters: int = 100, seed: int = 0xDEADBEEF, block: int = 25) -> DataFrame:
    """vertex and an estimate of the triangles through it, from the minima of niters hashes over neighbourhoods.

    Minima are taken `block` at a time, in place. Edges lie in a grid of blocks of
    either end, and a vertex's minima move once for each block that it is linked
    with, not once an edge. Null where niters is 0.
    """
    vertices = graph.vertices.withColumnRenamed("id", "vertex")
    if niters <= 0:
        return vertices.withColumn("triangles", F.lit(None).cast("double"))
    pairs = cut(graph.pairs().select("src", "dst"))
    e = by(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "src")
    sketch = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    size = sketch.count() * niters * 8
    parts = max(4, -(-size // MINIMA), math.isqrt(pairs.count() // HELD) + 1)
    sides = [F.collect_set(F.when(test, _block("dst", parts))).alias(name) for name, test in (("up", F.col("src") < F.col("dst")), ("down", F.col("src") > F.col("dst")))]
    sketch = sketch.join(e.groupBy("src").agg(*sides), "src")
    names = []
    for first in range(0, niters, block):
        trials = range(first, min(first + block, niters))
        minima = [F.min(F.xxhash64(F.lit(seed + t), F.lit(t), F.col("dst"))).alias(f"m{t}") for t in trials]
        names.append(f"_s{first}")
        sketch = sketch.join(e.groupBy("src").agg(*minima).select("src", F.array(*(f"m{t}" for t in trials)).alias(names[-1])), "src")
    sketch = cut(sketch.select(F.col("src").alias("id"), "d", "up", "down", F.concat(*names).alias("sketch")))

    def shared(edges: pa.Table, sketches: pa.Table) -> pa.Table:
        lower = sketches.column("lower").to_numpy()
        found = []
        for side, name in ((True, "src"), (False, "dst")):
            some = sketches.filter(pa.array(lower == side))
            ids, d = some.column("id").to_numpy(), some.column("d").to_numpy()
            order = np.argsort(ids)
            at = order[np.searchsorted(ids[order], edges.column(name).to_numpy())] if edges.num_rows else np.zeros(0, np.int64)
            found.append((ids, d, at, some.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, niters)))
        (a, da, i, x), (b, db, j, y) = found
        out_a, out_b = np.zeros(len(a)), np.zeros(len(b))
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            z = (x[p] == y[q]).sum(1)
            each = z / (z + niters) * (da[p] + db[q])
            np.add.at(out_a, p, each)
            np.add.at(out_b, q, each)
        return pa.table({"vertex": np.concatenate([a, b]), "_shared": np.concatenate([out_a, out_b])})

    deal = lambda df: df.repartition(4 * parts * parts, "i", "j").groupBy("i", "j")
    own = _block("id", parts)
    sent = lambda to, lower: sketch.select("id", "d", "sketch", F.lit(lower).alias("lower"), own.alias("_own"), F.explode(to).alias("_other")).select("id", "d", "sketch", "lower", *((F.col(x).alias(n) for x, n in zip(("_own", "_other") if lower else ("_other", "_own"), "ij", strict=True))))
    met = deal(pairs.select("src", "dst", _block("src", parts).alias("i"), _block("dst", parts).alias("j"))).cogroup(deal(sent("up", True).unionByName(sent("down", False)))).applyInArrow(shared, "vertex long, _shared double")
    ends = met.groupBy("vertex").agg((F.sum("_shared") / 2).alias("triangles"))
    return vertices.join(ends, "vertex", "left").select("vertex", F.coalesce("triangles", F.lit(0.0)).alias("triangles"))
