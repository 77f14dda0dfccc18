"""MinHash near-dedup by an LSH forest of sorted signature orders.

Each text becomes the set of its word shingles and a signature of `VALUES`
minima. A signature is sorted in `ORDERS` orders, each a rotation of its
values. In an order, texts with the same first `DEPTH` values are a region,
and sorting within it puts the longest common prefixes side by side, so the
depth at which two texts are neighbours adapts to how crowded their region is.

Candidates come in rounds, each verified on the full sets. In the first, a
text meets its nearest neighbours and its run's smallest id; in later rounds,
while links are still found, its nearest texts of other components, in growing
number. A component of more than `CROWD` classes is met as a whole: each text
that shares a region with it and isn't in it is compared with all its texts, in
blocks that yield links only. So a group of thousands of near copies costs some
neighbours a text, and no text is lost at its edge.

The windows of neighbours are no cap: what they can't reach is compared by an
exact way. Texts of small components in regions wider than the windows meet
by a prefix filter: shingles are put in a global order, rare ones first, and
two texts at the similarity share one of their first few. Texts that share much
but don't link crowd a region and still meet nobody there, since what they
share is frequent. Crowded components are met once more, by a join over whole
regions. So every two texts that share a region are compared, or known to be
in one component.

The orders are range-partitioned by region, following values and id, so a
crowded region spreads over tasks; the rows at the edges of tasks are brought
together once more. Equal sets are one class throughout, with an id of its own,
and are never paired. Only texts that share a region move to be verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles, tokens
from .common import NUMBERS, gathered, scratch, staged
from .components import components
from .runs import runs

VALUES, ORDERS, DEPTH = 80, 20, 4
#: Neighbours on either side, by round.
NEAR = (1, 3, 8)
#: Classes of a component that is met as a whole, from one more on; and texts of either side in a block.
CROWD, BLOCK = 16, 128
#: Texts that share a rare shingle are paired up to so many; more meet in blocks of WIDE, where COLUMNS shingles are counted at once.
PAIRED, WIDE, COLUMNS = 32, 256, 4096
#: Counters that tell rare shingles from frequent ones, and rows of the orders in a task, at most about.
SLOTS, ROWS = 1 << 18, 1 << 21
#: Of staged tables whose rows cost more than a few numbers: texts in a file, and pairs or texts compared in a task, at most about; and such tasks for each core, at least.
TEXTS, COMPARED, TASKS = 1 << 12, 1 << 10, 4
_RANDOM = np.random.default_rng(77)
_TIMES = _RANDOM.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)
CHUNK = 1 << 18


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """A row of VALUES 16-bit minima for each of some non-empty sets."""
    out = np.empty((len(sets), VALUES), np.uint16)
    at = 0
    while at < len(sets):
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop]) <= CHUNK):
            size += len(sets[stop])
            stop += 1
        flat = np.concatenate(sets[at:stop])
        starts = np.cumsum([0, *map(len, sets[at : stop - 1])])
        for k in range(VALUES):
            out[at:stop, k] = np.minimum.reduceat(flat * _TIMES[k] + _PLUS[k], starts) >> np.uint64(16) & np.uint64(0xFFFF)
        at = stop
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key (a hash of the text, which tells the rows of a repeated doc_id apart), n_shingles, two numbers that name the set, and the signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            data, offsets = shingles.bytes_of(batch.column(1))
            sets = [shingles.shingle_set(data[a:b], size) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            n = np.array([len(s) for s in sets], np.int64)
            names = np.array([[int(s.sum()), int(np.bitwise_xor.reduce(shingles.mixed(s + np.uint64(1))))] if len(s) else [0, 0] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            some = [s for s in sets if len(s)]
            made = iter(signature(some)) if some else iter(())
            signed = [next(made).tobytes() if k else None for k in n]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(signed, pa.binary())], ["doc_id", "key", "n_shingles", "h1", "h2", "sig"])

    return _keyed(docs).mapInArrow(run, "doc_id long, key long, n_shingles long, h1 long, h2 long, sig binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))


def forest(reps: DataFrame) -> DataFrame:
    """A row for each order of each signature: region, tail (the four values after its depth), id and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(ids):
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(ids), VALUES).astype(np.uint64)
            step = VALUES // ORDERS
            for order in range(ORDERS):
                turned = np.roll(sig, -order * step, axis=1)
                region = np.full(len(ids), order + 1, np.uint64)
                for k in range(DEPTH):
                    region = shingles.mixed(region * np.uint64(65599) + turned[:, k])
                tail = np.zeros(len(ids), np.uint64)
                for k in range(DEPTH, DEPTH + 4):
                    tail = tail << np.uint64(16) | turned[:, k]
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(tail.view(np.int64)), pa.array(ids), pa.array(n)], ["region", "tail", "id", "n"])

    return reps.select("id", "n_shingles", "sig").mapInArrow(run, "region long, tail long, id long, n long")


def _neighbours(rows: dict[str, np.ndarray], near: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of one task's sorted rows, pairs (a, b), the lower id first, and demands (id, component).

    Pairs lie within `near` places in a region; in the first round also at its
    run's least id. After that they are of different small components, and a
    row beside a crowded component of its region demands it, where its own is
    smaller.
    """
    region, ids, n, comp, crowd = (rows[k] for k in ("region", "id", "n", "component", "crowd"))
    found, asked = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]

    def keep(i: np.ndarray, j: np.ndarray, any_size: bool = False) -> None:
        ok = (ids[i] != ids[j]) & (comp[i] != comp[j]) & (np.maximum(crowd[i], crowd[j]) <= CROWD)
        if not any_size:
            ok &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * 80
        i, j = ids[i[ok]], ids[j[ok]]
        found.append(np.stack([np.minimum(i, j), np.maximum(i, j)], 1))

    size = len(ids)
    if not size:
        return found[0], asked[0]
    edge = np.flatnonzero(np.diff(region, prepend=region[0] - 1))
    run = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, size)))
    if first:
        for s in range(1, min(near, size - 1) + 1):
            i = np.flatnonzero(region[:-s] == region[s:])
            keep(i, i + s, s == 1)  # so that every text that shares a region is in a pair, and moves
        hub = np.lexsort((ids, run))[edge]
        members = np.flatnonzero((np.diff(np.append(edge, size)) > 1)[run])
        keep(members, hub[run[members]])
    else:
        # stretches of one component count as one step: a text meets the last `near` rows before its stretch and the first after it
        new = np.diff(region, prepend=region[0] - 1).astype(bool) | np.diff(comp, prepend=comp[0] - 1).astype(bool)
        stretch = np.flatnonzero(new)
        which = np.repeat(np.arange(len(stretch)), np.diff(np.append(stretch, size)))
        begin, end = stretch[which], np.append(stretch[1:], size)[which]
        mixed_run = np.add.reduceat(new.astype(np.int64), edge) > 1
        open_ = np.flatnonzero(mixed_run[run])
        for s in range(near):
            for j in (begin[open_] - 1 - s, end[open_] + s):
                ok = (j >= 0) & (j < size)
                i, k = open_[ok], j[ok]
                same = region[i] == region[k]
                keep(i[same], k[same])
        full = open_[crowd[open_] > CROWD]
        for r, c in np.unique(np.stack([run[full], comp[full]], 1), axis=0) if len(full) else ():
            own = np.arange(edge[r], edge[r + 1] if r + 1 < len(edge) else size)
            most = crowd[own[comp[own] == c]][0]
            own = own[(comp[own] != c) & ((crowd[own] < most) | ((crowd[own] == most) & (comp[own] > c)))]
            asked.append(np.stack([ids[own], np.full(len(own), c)], 1))
    return np.unique(np.concatenate(found), axis=0), np.unique(np.concatenate(asked), axis=0)


_ROW = "region long, tail long, id long, n long, component long, crowd long"


PAIR, DEMAND = -1, -2


def _pairs_of(ordered: DataFrame, near: int, first: bool) -> DataFrame:
    names = ["region", "tail", "id", "n", "component", "crowd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = {k: np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i, k in enumerate(names)}
        task = TaskContext.get().partitionId()
        for kind, made in zip((PAIR, DEMAND), _neighbours(rows, near, first), strict=True):
            blank = pa.nulls(len(made), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1]), pa.array(np.full(len(made), kind)), *[blank] * 6], ["a", "b", "task", *names])
        size = len(rows["id"])
        ends = np.unique(np.concatenate([np.arange(min(near, size)), np.arange(max(0, size - near), size)]))
        blank = pa.nulls(len(ends), pa.int64())
        yield pa.RecordBatch.from_arrays([blank, blank, pa.array(np.full(len(ends), task)), *(pa.array(rows[k][ends]) for k in names)], ["a", "b", "task", *names])

    return ordered.mapInArrow(run, f"a long, b long, task long, {_ROW}")


def candidates(rows: DataFrame, near: int, first: bool, parts: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b, task) of neighbours in the sorted orders, those across the edges of tasks included, where task tells pairs from demands; and the regions that more than two tasks hold, whose windows may be broken."""
    ordered = rows.repartitionByRange(parts, "region", "tail", "id").sortWithinPartitions("region", "tail", "id")
    made = staged(_pairs_of(ordered, near, first), "candidates")
    inner = made.filter("task < 0").select("a", "b", "task")
    # a seam is the end of one task and the start of the next: a few rows, in a group of their own
    ends = made.filter("task >= 0")
    seams = ends.select("*", F.explode(F.expr("array(task, task + 1)")).alias("seam"))

    def join(key: tuple, batch: pa.Table) -> pa.Table:
        t = batch.sort_by([("region", "ascending"), ("tail", "ascending"), ("id", "ascending")])
        rows = {k: t[k].to_numpy() for k in ("region", "id", "n", "component", "crowd")}
        made = _neighbours(rows, near, first)
        both = np.concatenate(made)
        return pa.table({"a": both[:, 0], "b": both[:, 1], "task": np.repeat(np.array([PAIR, DEMAND]), [len(x) for x in made])})

    across = seams.drop("a", "b", "task").groupBy("seam").applyInArrow(join, "a long, b long, task long")
    torn = ends.groupBy("region").agg(F.count_distinct("task").alias("_tasks")).filter("_tasks > 2").select("region")
    return inner.unionByName(across).distinct(), torn


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the similarity."""
    left, right = texts.toDF("a", "_ta"), texts.toDF("b", "_tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            keep = []
            sides = [(batch.column(c).to_numpy(), *shingles.bytes_of(batch.column(d))) for c, d in ((0, 2), (1, 3))]
            for row in range(batch.num_rows):
                sets = []
                for ids, data, offsets in sides:
                    x = known.get(int(ids[row]))
                    if x is None:
                        x = shingles.shingle_set(data[offsets[row] : offsets[row + 1]], size)
                        held += len(x)
                        if held > 1 << 21:
                            known.clear()
                            held = len(x)
                        known[int(ids[row])] = x
                    sets.append(x)
                one, other = sets if len(sets[0]) <= len(sets[1]) else sets[::-1]
                at = np.searchsorted(other, one)
                at[at == len(other)] = 0
                both = int((other[at] == one).sum()) if len(other) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(one) + len(other) - both))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], ["a", "b"])

    # merge joins at every size: texts move once or twice in proportion to the pairs, and hot ids can be split
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "_ta", "_tb")
    return met.mapInArrow(run, "a long, b long")


def meet_crowds(demands: DataFrame, labels: DataFrame, sizes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The links (a, b) between texts and the crowded components that they demand (id, component): every member compared, in blocks of members and of texts."""
    asking = demands.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
    shape = asking.join(sizes, "component").select("component", "_parts", F.ceil(F.col("crowd") / BLOCK).alias("_blocks"))
    member = labels.withColumnRenamed("node", "id").join(shape, "component").select("component", F.pmod(F.xxhash64("id"), "_blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "id", F.lit(True).alias("member"))
    asker = demands.join(shape, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), "_parts").alias("part"), "id", F.lit(False).alias("member"))
    rows = member.unionByName(asker).join(texts.hint("merge"), "id").select("component", "block", "part", "id", "member", "text")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        data, offsets = shingles.bytes_of(t["text"].combine_chunks() if t["text"].num_chunks != 1 else t["text"].chunk(0))
        sets = [shingles.shingle_set(data[a:b], size) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        inside = t["member"].to_numpy(zero_copy_only=False)
        ids, ours, theirs = t["id"].to_numpy(), np.flatnonzero(inside), np.flatnonzero(~inside)
        links = []
        if len(ours):
            flat = np.concatenate([sets[i] for i in ours])
            owner = np.repeat(np.arange(len(ours)), [len(sets[i]) for i in ours])
            order = np.argsort(flat, kind="stable")
            flat, owner, n = flat[order], owner[order], np.array([len(sets[i]) for i in ours])
            for x in theirs:
                first, last = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
                times = last - first
                at = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                both = np.bincount(owner[at], minlength=len(ours))
                links += [(ids[x], ids[ours[m]]) for m in np.flatnonzero((both > 0) & (100 * both >= percent * (n + len(sets[x]) - both)))]
        return pa.table({"a": pa.array([int(a) for a, _ in links], pa.int64()), "b": pa.array([int(b) for _, b in links], pa.int64())})

    return rows.groupBy("component", "block", "part").applyInArrow(run, "a long, b long")


def _known(rows: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of the orders with their component and its classes."""
    known = labels.withColumnRenamed("node", "id").join(sizes, "component")
    return rows.join(known, "id", "left").select("region", "tail", "id", "n", F.coalesce("component", "id").alias("component"), F.coalesce("crowd", F.lit(1)).cast("long").alias("crowd"))


def _sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("crowd"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of some sets share."""
    every, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.flatnonzero((times > 1)[column])  # what one set alone holds counts nowhere
    place = (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[shared][order], place[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [at, at + COLUMNS])
        holds = np.zeros((len(sets), COLUMNS), np.float32)
        holds[owner[a:b], place[a:b] - at] = 1
        both += holds @ holds.T
    return both.astype(np.int64)


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many first members of a set of n, in any fixed order, hold one of every set at the similarity."""
    return n + 1 + -percent * n // 100


def meet_wide(at: DataFrame, near: int, torn: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the texts of small components in regions with more rows than `near` places reach, or torn ones: pairs (a, b) that share a rare shingle and are to be verified, and links (a, b) of shingles that many share, one for each two components that a block links."""
    small = F.when(F.col("crowd") <= CROWD, F.col("component"))
    region = at.groupBy("region").agg(F.count(F.lit(1)).alias("_n"), F.min(small).alias("_low"), F.max(small).alias("_high"))
    mixed = region.filter("_low <> _high").join(torn.withColumn("_torn", F.lit(True)), "region", "left").filter((F.col("_n") > near + 1) | F.col("_torn"))
    some = at.filter(F.col("crowd") <= CROWD).join(mixed.select("region"), "region", "left_semi").select("id", "component").distinct()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = shingles.bytes_of(batch.column(2))
            sets = [shingles.shingle_set(data[a:b], size).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["id", "component", "shingles"])

    held = some.join(texts.hint("merge"), "id").select("id", "component", "text").mapInArrow(shingled, "id long, component long, shingles binary")
    sets = staged(gathered(held, texts.count(), TEXTS, TASKS), "sets")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(x, np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    # how often each slot's shingles stand: SLOTS numbers, whatever the input
    counts = np.zeros(SLOTS, np.int64)
    told = sets.select("shingles").mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts[told["slot"].to_numpy(np.int64)] = told["n"].to_numpy(np.int64)
    shared = at.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, comp, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.frombuffer(raw, np.uint64)
                often = shared.value[(x % np.uint64(SLOTS)).astype(np.int64)]
                first = np.lexsort((x, often))[: prefix_length(len(x), percent)]
                place = np.flatnonzero(often[first] > 1)  # what one text alone holds leads nowhere
                out.append((x[first[place]].view(np.int64), np.full(len(place), i), np.full(len(place), comp), np.full(len(place), len(x)), place))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["shingle", "id", "component", "n", "place"])

    rows = staged(sets.mapInArrow(prefixes, "shingle long, id long, component long, n long, place long"), "prefixes")
    met = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n"), F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_n > 1 and _low <> _high")
    cut = staged(gathered(rows.join(met.select("shingle", "_n"), "shingle"), rows.count()), "shared")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 1):
            key, ids, comp, n, place = (t.column(k).to_numpy() for k in range(5))
            for s in range(1, min(PAIRED, len(ids))):
                i = np.flatnonzero(key[:-s] == key[s:])
                if not len(i):
                    break
                j = i + s
                least = -(-percent * (n[i] + n[j]) // (100 + percent))  # the overlap that the similarity asks for
                ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= least)
                a, b = ids[i[ok]], ids[j[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    few = cut.filter(F.col("_n") <= PAIRED).drop("_n").repartition("shingle").sortWithinPartitions("shingle")
    pairs = few.mapInArrow(paired, "a long, b long").distinct()
    many = cut.filter(F.col("_n") > PAIRED).withColumn("_blocks", F.ceil(F.col("_n") / WIDE)).withColumn("own", F.pmod(F.xxhash64("id"), "_blocks"))
    spread = many.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    keyed = spread.select("shingle", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "id")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        own, ids, comp = (t[k].to_numpy() for k in ("own", "id", "component"))
        n, both = np.array([len(s) for s in sets]), overlaps(sets)
        linked = np.triu((both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both)), 1) & (comp[:, None] != comp[None, :])
        if key[1].as_py() != key[2].as_py():
            linked &= own[:, None] != own[None, :]
        x, y = np.nonzero(linked)
        ends = np.stack([np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])], 1)
        once = np.unique(ends, axis=0, return_index=True)[1] if len(x) else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(ids[x[once]], pa.int64()), "b": pa.array(ids[y[once]], pa.int64())})

    held = keyed.join(sets.hint("merge"), "id").select("shingle", "i", "j", "own", "id", "component", "shingles")
    return pairs, held.groupBy("shingle", "i", "j").applyInArrow(run, "a long, b long").distinct()


def demanded(at: DataFrame) -> DataFrame:
    """id, component and crowd: each crowded component that a text shares a region with, isn't in, and isn't in a larger one than."""
    crowds = at.filter(F.col("crowd") > CROWD).select("region", "component", "crowd").distinct()
    own = at.select("region", "id", F.col("component").alias("_own"), F.col("crowd").alias("_n"))
    larger = (F.col("_n") < F.col("crowd")) | ((F.col("_n") == F.col("crowd")) & (F.col("_own") > F.col("component")))
    met = own.alias("o").join(crowds.alias("c").hint("merge"), (F.col("o.region") == F.col("c.region")) & (F.col("_own") != F.col("component")) & larger)
    return met.select("id", "component", "crowd").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs.

    size: words in a shingle; percent: the least similarity. Null, empty and
    wordless texts have no shingles and are components of their own. Rows that
    repeat a doc_id are each judged by their own text; what either links with,
    the id links with. A row without a doc_id has the component of its text,
    null if no row of it has one. Other columns are not read. An empty table
    gives an empty result.
    """
    with scratch():
        name = ["h1", "h2", "n_shingles"]
        sigs = staged(signatures(docs, size), "signatures")
        one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("of")
        classes = sigs.filter("n_shingles > 0").groupBy(*name).agg(one, F.first("sig").alias("sig"))
        n = sigs.count()
        classes = classes.select(F.monotonically_increasing_id().alias("id"), *name, F.col("of.doc_id").alias("doc"), F.col("of.key").alias("key"), "sig")
        classes = staged(gathered(classes, n, NUMBERS // 8), "classes")
        own = sigs.select("doc_id", *name).join(classes.select("id", *name), name, "left").select("doc_id", "n_shingles", "id")
        own = staged(gathered(own, n), "own", lasting=True)
        rows = staged(forest(classes), "forest")
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * ORDERS // ROWS))
        plain = rows.withColumns({"component": F.col("id"), "crowd": F.lit(1).cast("long")})
        found, torn = candidates(plain, NEAR[0], True, parts)
        pairs = staged(gathered(found.select("a", "b"), n * ORDERS), "pairs")
        shared = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b"))).distinct()
        chosen = classes.join(shared, "id", "left_semi").select("id", F.coalesce("doc", F.lit(0)).alias("_doc"), "key")
        # merge joins at every size: texts move in proportion to the input, and hot ids can be split
        moved = _keyed(docs).select(F.coalesce("doc_id", F.lit(0)).alias("_doc"), "key", "text").join(chosen.hint("merge"), ["_doc", "key"])
        texts = staged(gathered(moved.groupBy("_doc", "key", "id").agg(F.first("text").alias("text")).select("id", "text"), n, TEXTS, TASKS), "texts")
        links = staged(gathered(verify(pairs, texts, size, percent).unionByName(repeated(own)), pairs.count(), COMPARED, TASKS), "links")
        labels = components(links)
        seen, met = pairs, None
        for near in NEAR[1:]:
            sizes = _sizes(labels)
            found, torn = candidates(_known(rows, labels, sizes), near, False, parts)
            found = staged(gathered(found, n * ORDERS), "pairs")
            pairs = found.filter(F.col("task") == PAIR).select("a", "b")
            demands = found.filter(F.col("task") == DEMAND).select(F.col("a").alias("id"), F.col("b").alias("component")).join(sizes, "component")
            if met is not None:  # a component as it was needn't be met again
                demands = demands.join(met, ["id", "component", "crowd"], "left_anti")
            met = demands if met is None else met.unionByName(demands)
            more = verify(pairs.join(seen, ["a", "b"], "left_anti"), texts, size, percent)
            more = more.unionByName(meet_crowds(demands.select("id", "component"), labels, sizes, texts, size, percent))
            more = staged(gathered(more, found.count(), COMPARED, TASKS), "links")
            seen = seen.unionByName(pairs)
            if more.isEmpty():
                break
            links = links.unionByName(more)
            labels = components(links)
        # what shares a region and isn't in one component by now: small ones by rare shingles, the others with the crowded component
        sizes = _sizes(labels)
        at = staged(gathered(_known(rows, labels, sizes), n * ORDERS), "regions")
        demands = demanded(at)
        if met is not None:
            demands = demands.join(met, ["id", "component", "crowd"], "left_anti")
        demands = staged(gathered(demands.select("id", "component"), n * ORDERS), "demands")
        pairs, blocks = meet_wide(at, near, torn, texts, size, percent)
        more = verify(pairs.join(seen, ["a", "b"], "left_anti"), texts, size, percent).unionByName(blocks)
        more = more.unionByName(meet_crowds(demands, labels, sizes, texts, size, percent))
        more = staged(gathered(more, texts.count(), COMPARED, TASKS), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
        of = classes.select("id", "doc").join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "doc", F.coalesce("component", "id").alias("component"))
        least = of.groupBy("component").agg(F.min("doc").alias("component_id"))
        named = staged(gathered(of.join(least, "component").select("id", "component_id", F.lit(True).alias("_known")), n), "named", lasting=True)
    out = own.join(named, "id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def repeated(own: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of one doc_id, where its rows have different texts."""
    some = own.filter("doc_id is not null and id is not null").select("doc_id", "id")
    several = some.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("_last")).filter("a <> _last").select("doc_id", "a")
    return some.join(several, "doc_id").filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near duplicates of a kept document; all columns stay."""
    gone = near_duplicates(docs, size, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
