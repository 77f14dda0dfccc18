"""Embedding near-dedup by NN-descent.

Equal vectors of a label are one class. Each class starts with neighbours from
sorted orders of hyperplane signs. A round brings together, at every class, its
neighbours and those whose neighbour it is, compares them with each other and
keeps each one's nearest. A list full of links is saturated: it might hide
links to other groups, so it is enlarged by the nearest vectors outside the
class's component. The rounds end when none finds a link; a fixed number of
queries, half of them with links, is then held against all vectors, and too
low a recall starts new orders and rounds. If it stays low, all vectors of a
label are compared in blocks.

Links are confirmed in double precision. Within a component, links are counted
exactly. Angles to one member bound those between members: vectors near it are
linked all and counted by their number, those in rings far apart by none, and
only the rest is multiplied, in blocks that yield counts and never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, scratch, staged, staged_as
from .components import components
from .runs import bounds, runs

THRESHOLD = 0.98
K, ORDERS, SIDE, BITS = 8, 12, 8, 30
#: The greatest list of neighbours that meets in one task; longer ones meet in parts.
MEETING = 256
BLOCK = 512
AUDITED, RECALL, TRIES = 500, 0.999, 4
#: Rings within the angle of a link; a bit more than a whole number, so that rounding changes no ring's place.
RINGS = 8.001
#: What single precision may lose; candidates within it are confirmed in double precision.
MARGIN = 1e-5


def matrix(rows: list[bytes], kind: type) -> np.ndarray:
    """Vectors of one length."""
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, space (label and length; null where the vector links with nothing), name of the exact vector, and its direction in double and in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for vec, label, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                space = name = unit = small = None
                if label is not None and value and all(x is not None for x in value):
                    x = np.array(value, np.float64)
                    with np.errstate(all="ignore"):
                        x = x / np.abs(x).max() if np.isfinite(x).all() and x.any() else x * np.nan
                        x = x / np.sqrt((x * x).sum())
                    if np.isfinite(x).all():
                        space, name, unit = f"{label}/{len(x)}", hashlib.md5(np.array(value, np.float64).tobytes()).digest(), x.tobytes()
                        small = x.astype(np.float32).tobytes()
                rows.append((vec, space, name, unit, small))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["vec_id", "space", "name", "unit", "small"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, space string, name binary, unit binary, small binary")


EDGE = "a long, b long, cos float"


def _best(own: np.ndarray, other: np.ndarray, cos: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` nearest of each own, each once."""
    order = np.lexsort((other, own))
    own, other, cos = own[order], other[order], cos[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (other[1:] != other[:-1])])[: len(own)]
    own, other, cos = own[new], other[new], cos[new]
    order = np.lexsort((-cos, own))
    own, other, cos = own[order], other[order], cos[order]
    first = np.flatnonzero(np.diff(own, prepend=own[:1] - 1))
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    ok = place < most
    return own[ok], other[ok], cos[ok]


def _edges(own: np.ndarray, other: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(other, pa.int64()), pa.array(cos.astype("f4"))], ["a", "b", "cos"])


def _beside(region: np.ndarray, ids: np.ndarray, x: np.ndarray, side: int, most: int) -> pa.RecordBatch:
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for s in range(1, min(side, len(ids) - 1) + 1):
        i = np.flatnonzero(region[:-s] == region[s:])
        cos = np.einsum("ij,ij->i", x[i], x[i + s])
        found += [(ids[i], ids[i + s], cos), (ids[i + s], ids[i], cos)]
    own, other, cos = (np.concatenate(c) for c in zip(*found, strict=True))
    return _edges(*_best(own, other, cos, most))


def orders(classes: DataFrame, seed: int) -> DataFrame:
    """First neighbours: of ORDERS orders by the signs of hyperplanes, the nearest of those SIDE places away."""
    names = ["region", "code", "id", "unit"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, space, units = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()), batch.column(2).to_pylist()
            for size in sorted(set(map(len, units))):
                at = np.array([i for i, u in enumerate(units) if len(u) == size])
                x = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), -1)
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, ORDERS * BITS))
                signs = (x @ planes[d] > 0).reshape(len(at), ORDERS, BITS)
                codes = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                small = [u.tobytes() for u in x.astype(np.float32)]
                for k in range(ORDERS):
                    yield pa.RecordBatch.from_arrays([pa.array([f"{s}/{k}" for s in space[at]]), pa.array(codes[:, k]), pa.array(ids[at]), pa.array(small, pa.binary())], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ends, held, n = TaskContext.get().partitionId(), [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if n < SIDE:
                ends.append(table.slice(0, SIDE - n))
            n += table.num_rows
            table = pa.concat_tables([held, table]) if held is not None else table
            yield from widths(table)
            held = table.slice(max(0, table.num_rows - SIDE))
        if held is not None:
            seam = pa.concat_tables([*(e.append_column("seam", pa.array([task] * e.num_rows, pa.int64())) for e in ends), held.append_column("seam", pa.array([task + 1] * held.num_rows, pa.int64()))])
            blank = pa.nulls(seam.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([blank, blank, pa.nulls(seam.num_rows, pa.float32()), seam["seam"].combine_chunks(), *(seam[k].combine_chunks() for k in names)], ["a", "b", "cos", "seam", *names])

    def widths(table: pa.Table) -> Iterator[pa.RecordBatch]:
        e = beside(table)
        yield pa.RecordBatch.from_arrays([*e.columns, *(pa.nulls(e.num_rows, t) for t in (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["a", "b", "cos", "seam", *names])

    def beside(table: pa.Table) -> pa.RecordBatch:
        units, regions, ids = table["unit"].to_pylist(), np.array(table["region"].to_pylist()), table["id"].to_numpy()
        out = []
        for size in sorted(set(map(len, units))):
            at = np.array([i for i, u in enumerate(units) if len(u) == size])
            out.append(_beside(regions[at], ids[at], np.frombuffer(b"".join(units[i] for i in at), np.float32).reshape(len(at), -1), SIDE, K))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(e.num_rows for e in out) else _edges(*[np.zeros(0)] * 3)

    def seamed(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([beside(table.sort_by([("region", "ascending"), ("code", "ascending"), ("id", "ascending")]))])

    coded = classes.select("rep", "space", "unit").mapInArrow(code, "region string, code long, id long, unit binary")
    ordered = coded.repartitionByRange("region", "code", "id").sortWithinPartitions("region", "code", "id")
    made = staged(ordered.mapInArrow(meet, f"{EDGE}, seam long, region string, code long, id long, unit binary"), "orders")
    across = made.filter("seam is not null").select("seam", *names).groupBy("seam").applyInArrow(seamed, EDGE)
    return made.filter("seam is null").select("a", "b", "cos").unionByName(across)


def nearest(edges: DataFrame, labels: DataFrame | None, k: int = K) -> DataFrame:
    """Of each class its k nearest, and where all of these are links, k more that are not in its component."""
    own = edges.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("old").alias("old")).withColumn("old", F.coalesce("old", F.lit(False)))
    ranked = own.withColumn("_place", F.expr("row_number() over (partition by a order by cos desc, b)"))
    if labels is None:
        return ranked.filter(F.col("_place") <= k).drop("_place")
    known = labels.select(F.col("node").alias("_n"), "component")
    with_a = ranked.join(known.toDF("a", "_ca"), "a", "left").join(known.toDF("b", "_cb"), "b", "left")
    outside = F.coalesce("_ca", "a") != F.coalesce("_cb", "b")
    more = with_a.withColumn("_out", outside).withColumn("_rank", F.expr(f"sum(int(_out and _place > {k})) over (partition by a order by _place rows unbounded preceding)"))
    full = F.expr(f"min(if(_place <= {k}, cos, null)) over (partition by a) >= {THRESHOLD}")
    return more.withColumn("_full", full).filter((F.col("_place") <= k) | (F.col("_full") & F.col("_out") & (F.col("_rank") <= k))).select("a", "b", "cos", "old")


def refine(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """A round: new edges between neighbours of a class, where they are nearer than the worst in a list."""
    worst = lists.groupBy("a").agg(F.min("cos").alias("worst"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("b"), F.when(F.col("n") >= K, F.col("worst")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    both = lists.select("a", "b", "old").unionByName(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "old")).groupBy("a", "b").agg(F.min("old").alias("old"))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    parts = both.join(degree, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / MEETING)).cast("long"))
    met = parts.join(worst, "b", "left").join(classes.select(F.col("rep").alias("b"), "small"), "b")
    ready = met.select("a", "part", "b", "old", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"), "small").repartition("a", "part").sortWithinPartitions("a", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 2):
            at = bounds(table, 2)
            ids, old, worst, small = table["b"].to_numpy(), table["old"].to_numpy(), table["worst"].to_numpy(), table["small"].to_pylist()
            out = []
            for s, e in zip(at[:-1], at[1:], strict=True):
                x = matrix(small[s:e], np.float32)
                cos = x @ x.T
                fresh = ~(old[s:e, None] & old[None, s:e])
                np.fill_diagonal(fresh, False)
                i, j = np.nonzero(fresh & (cos > worst[s:e, None]))
                if len(i):
                    out.append(_best(i, j, cos[i, j], K))
                    out[-1] = (ids[s:e][out[-1][0]], ids[s:e][out[-1][1]], out[-1][2])
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return ready.mapInArrow(run, EDGE)


def _pairwise(pairs: DataFrame, classes: DataFrame, test: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Those of the pairs whose cosine in double precision passes."""
    of = classes.select("rep", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cos = np.array([float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
                ok = pa.array(test(cos))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    met = pairs.join(of.toDF("a", "_ua"), "a").join(of.toDF("b", "_ub"), "b").select("a", "b", "_ua", "_ub")
    return met.mapInArrow(run, "a long, b long")


def confirmed(edges: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    likely = edges.filter(F.col("cos") >= threshold - MARGIN).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _pairwise(likely, classes, lambda cos: cos >= threshold)


def audit(classes: DataFrame, labels: DataFrame, threshold: float) -> float:
    """Of AUDITED classes (by a hash of their ids, half from all and half from those with links), held against all: the mean share of a class's links that lie within a component; 1 where none has links."""
    linked = classes.join(labels.select(F.col("node").alias("rep")), "rep", "left_semi")
    of = ("rep", "space", "unit")
    asked = {r.rep: r for d in (classes, linked) for r in d.select(*of).orderBy(F.xxhash64("rep"), "rep").limit(AUDITED // 2).collect()}.values()
    if not asked:
        return 1.0
    by: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for s in {r.space for r in asked}:
        own = [r for r in asked if r.space == s]
        by[s] = np.array([r.rep for r in own]), np.array([np.frombuffer(r.unit) for r in own])
    shared = classes.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spaces = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist())
            for s in set(spaces) & shared.value.keys():
                at = np.flatnonzero(spaces == s)
                reps, x = shared.value[s]
                i, j = np.nonzero(x @ matrix(batch.column(2).take(pa.array(at)).to_pylist(), np.float64).T >= threshold)
                ok = reps[i] != ids[at][j]
                yield pa.RecordBatch.from_arrays([pa.array(reps[i[ok]]), pa.array(ids[at][j[ok]])], ["a", "b"])

    true = classes.select(*of).mapInArrow(run, "a long, b long")
    both = true.join(labels.toDF("a", "_ca"), "a", "left").join(labels.toDF("b", "_cb"), "b", "left")
    each = both.groupBy("a").agg(F.avg((F.coalesce("_ca", "a") == F.coalesce("_cb", "b")).cast("double")).alias("share"))
    return each.agg(F.coalesce(F.avg("share"), F.lit(1.0))).first()[0]


def ringed(members: DataFrame, threshold: float) -> DataFrame:
    """members (key, rep, unit, …) with ring: how many times an eighth of a link's angle it lies from the key's least rep."""
    theta = float(np.arccos(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cos = np.array([float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((np.arccos(np.clip(cos, -1, 1)) * RINGS / theta).astype(np.int64))], ["rep", "ring"])

    first = members.groupBy("key").agg(F.min("rep").alias("rep")).join(members.select("rep", F.col("unit").alias("_lead")), "rep").select("key", "_lead")
    rings = members.join(first, "key").select("rep", "unit", "_lead").mapInArrow(run, "rep long, ring long")
    return members.join(rings, "rep")


def celled(members: DataFrame) -> DataFrame:
    """key, i, j, own, rep, component, copies, unit: each member in the cells that hold all pairs that rings leave open. i and j are (ring, part) of a cell's two sides, each of about BLOCK members."""
    most, sure = int(RINGS) + 1, int(RINGS) - 2
    shape = members.groupBy("key", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
    # the rings that each ring of a key must meet: so that only vectors in them are copied
    pairs = shape.withColumnRenamed("_parts", "_mine").join(shape.withColumnRenamed("ring", "_ring"), "key").filter((F.abs(F.col("ring") - F.col("_ring")) <= most) & (F.col("ring") + F.col("_ring") > sure))
    met = members.join(pairs, ["key", "ring"]).withColumn("own", F.struct("ring", F.pmod(F.xxhash64("rep"), "_mine").alias("part")))
    open_ = met.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    open_ = open_.withColumn("_other", F.struct(F.col("_ring").alias("ring"), F.col("_part").alias("part")))
    return open_.select("key", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "rep", "component", "copies", "unit")


def _cells(ready: DataFrame, threshold: float, links: bool) -> DataFrame:
    """Of cells, rep and n, how many vectors of the other side (of its own, where there is one) it links with; or links (a, b) between components, one for each two that a cell links."""
    flat = ready.select("key", *(F.col(f"{c}.{k}").alias(f"{c}_{k}") for c in ("i", "j") for k in ("ring", "part")), (F.col("own") == F.col("i")).alias("first"), "rep", "component", "copies", "unit")
    keys = flat.columns[:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 5):
            at = bounds(table, 5)
            ir, ip, jr, jp = (table[k].to_numpy() for k in keys[1:])
            ids, comp, copies, first = (table[k].to_numpy() for k in ("rep", "component", "copies", "first"))
            units = table["unit"].to_pylist()
            for s, e in zip(at[:-1], at[1:], strict=True):
                alone = ir[s] == jr[s] and ip[s] == jp[s]
                x = matrix(units[s:e], np.float64)
                left = np.arange(e - s) if alone else np.flatnonzero(first[s:e])
                right = left if alone else np.flatnonzero(~first[s:e])
                linked = x[left] @ x[right].T >= threshold
                if alone:
                    np.fill_diagonal(linked, False)
                if links:
                    i, j = np.nonzero(linked)
                    a, b = s + left[i], s + right[j]
                    ends = np.stack([np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])], 1)
                    apart = np.flatnonzero(ends[:, 0] != ends[:, 1])
                    once = apart[np.unique(ends[apart], axis=0, return_index=True)[1]] if len(apart) else apart
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a[once]]), pa.array(ids[b[once]])], ["a", "b"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s + left]), pa.array(linked @ copies[s + right])], ["a", "b"])
                    if not alone:
                        yield pa.RecordBatch.from_arrays([pa.array(ids[s + right]), pa.array(linked.T @ copies[s + left])], ["a", "b"])

    return flat.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def counted(classes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """rep and its links to vectors of other classes."""
    own = classes.select("rep", "copies", "unit").join(labels.toDF("rep", "component"), "rep").withColumn("key", F.col("component"))
    members = staged(ringed(own, threshold), "rings")
    sure = int(RINGS) - 2
    held = members.filter(F.col("ring") <= sure).groupBy("key", "ring").agg(F.sum("copies").alias("_n"))
    sums = held.toDF("key", "_ring", "_n").join(held.select("key", "ring"), "key").filter(F.col("ring") + F.col("_ring") <= sure).groupBy("key", "ring").agg(F.sum("_n").alias("_n"))
    near = members.join(sums, ["key", "ring"]).select("rep", (F.col("_n") - F.when(F.col("ring") * 2 <= sure, F.col("copies")).otherwise(0)).alias("n"))
    rest = _cells(celled(members), threshold, False).toDF("rep", "n")
    return near.unionByName(rest).groupBy("rep").agg(F.sum("n").alias("n"))


def compared(classes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join all components that should be one: every two vectors of a space compared, but for rings too far apart. The last resort."""
    own = classes.select("rep", "copies", "unit", F.col("space").alias("key")).join(labels.toDF("rep", "component"), "rep", "left")
    members = staged(ringed(own.withColumn("component", F.coalesce("component", "rep")), threshold), "rings")
    # within a key's near rings all are linked: with its least rep
    near = members.groupBy("key").agg(F.min("rep").alias("a")).join(members.filter(F.col("ring") <= int(RINGS) - 2), "key").filter("a <> rep").select("a", F.col("rep").alias("b"))
    return near.unionByName(_cells(celled(members), threshold, True)).distinct()


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each row of vectors.

    Vectors link with those of the same label and length. Null, empty and zero
    vectors, those with null or non-finite components, and those without a
    label link with nothing. Rows that repeat a vec_id count as vectors of
    their own. A row without a vec_id has the component of its links, null if
    no vector there has one. Other columns are not read.
    """
    with scratch():
        own = staged(prepared(vectors), "vectors")
        usable = own.filter("space is not null")
        grouped = usable.groupBy("space", "name").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"), F.first("small").alias("small"))
        classes = staged(grouped.select(F.monotonically_increasing_id().alias("rep"), "*"), "classes")
        edges = labels = None
        for attempt in range(TRIES):
            new = orders(classes, attempt).withColumn("old", F.lit(False))
            edges, edges_at = staged_as(nearest(new if edges is None else edges.unionByName(new), labels), "lists")
            before = -1
            while True:
                links = staged(confirmed(edges, classes, threshold), "links")
                labels = components(links)
                joined = labels.filter("node <> component").count()
                if joined == before:
                    break
                before = joined
                made = refine(edges, classes).withColumn("old", F.lit(False))
                last_at = edges_at
                edges, edges_at = staged_as(nearest(edges.withColumn("old", F.lit(True)).unionByName(made), labels), "lists")
                drop_staged(last_at)
            if audit(classes, labels, threshold) >= RECALL:
                break
        else:
            labels = components(staged(links.unionByName(compared(classes, labels, threshold)), "links"))
        n = staged(counted(classes, labels, threshold), "counts")
        known = classes.select("space", "name", "rep", "least", "copies").join(labels.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        known = staged(known.join(n, "rep", "left").select("space", "name", "least", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
        named = known.join(known.groupBy("component").agg(F.min("least").alias("component_id")), "component")
        named = staged(named.select("space", "name", "n_links", "component_id", F.lit(True).alias("_known")), "named", lasting=True)
        own = staged(own.select("vec_id", "space", "name"), "names", lasting=True)
    out = own.join(named, ["space", "name"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
