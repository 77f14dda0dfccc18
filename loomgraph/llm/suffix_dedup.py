"""Exact removal of repeated byte strings, by suffix sorting with bucket pointers.

A byte goes if a string of `length` bytes that covers it also starts in a
document with a smaller doc_id. Sorting every suffix of the corpus would move
each byte many times over, so strings are first brought to where they can
meet. Every window of `length` bytes has a seed: the gram of `GRAM` bytes in it
with the least hash, the leftmost of equals. Equal windows have equal seeds.
Consecutive windows with one seed make a stretch, a string of the text.

1. Documents are packed into chunks, in a table bucketed by chunk; later steps
   read it in place, and only seeds, strings of seeds that repeat, and answers
   move.
2. Of each chunk the seeds and how many different stretches each has there go
   to the seed's bucket. A seed with one stretch in one chunk is done: its
   windows are nowhere else. The others are asked for.
3. The stretches of these seeds move to the seed's bucket. All their suffixes
   are sorted up to `length` bytes: initial buckets by 8 bytes, then each bucket
   refined by the bucket identifiers at later offsets (8, 16, 18 more bytes),
   with the identifiers of one level reused by the next. Windows in one final
   bucket are equal, and each gets the bucket's least doc_id.
4. Each chunk finds its removed bytes from the answers.

Hashes only bring strings together. What counts as equal is decided by bytes:
by the sort, and before it, so that a stretch is sent once by each chunk and
sorted once, by comparing the strings. A seed of very many stretches, a common
gram in ever new surroundings, is split: its windows go by what else they must
share, the gram with the bytes before it or with those after it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import delete, drop_staged, shared_dir, staged, staged_as

LENGTH, GRAM = 50, 16
#: Bytes of text in a chunk, of text scanned at once, entries in a bucket, and bytes of strings in a bucket.
CHUNK, SCAN = 8 << 20, 1 << 20
ENTRIES, STRINGS = 1_500_000, 1_500_000
#: A seed with more stretches than this, each counted once a chunk, is split.
HOT = 5_000
#: Stretches whose bytes are compared at once.
COMPARED = 1 << 14
NO_ID = np.iinfo(np.int64).max
PACKED = "chunk long, ids binary, sizes binary, body binary"
#: A seed of a chunk and its different stretches there.
_SEED = np.dtype([("seed", "<u4"), ("n", "<u2")])
#: A string: the number of its stretch among the chunk's different ones, its first window there, and the least doc_id in the chunk.
_ENTRY = np.dtype([("number", "<u4"), ("at", "<u2"), ("doc", "<i8")])
#: Windows of a stretch that a smaller document holds.
_RUN = np.dtype([("number", "<u4"), ("at", "<u2"), ("n", "<u2"), ("doc", "<i8")])
_SIDES = np.random.default_rng(31).integers(1, 1 << 62, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def packed(docs: DataFrame) -> DataFrame:
    """Chunks of the documents' bytes, compressed, with their doc_ids and sizes; a null doc_id is the greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        sizes: list[int] = []
        body = bytearray()

        def row() -> pa.RecordBatch:
            nonlocal number, ids, sizes, body
            data = pa.compress(bytes(body), codec="zstd", asbytes=True)
            out = [[task << 24 | number], [np.array(ids, "<i8").tobytes()], [np.array(sizes, "<i8").tobytes()], [data]]
            number, ids, sizes, body = number + 1, [], [], bytearray()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], ["chunk", "ids", "sizes", "body"])

        for batch in batches:
            data, offsets = shingles.bytes_of(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids.append(NO_ID if doc is None else doc)
                sizes.append(int(offsets[i + 1] - offsets[i]))
                body += data[offsets[i] : offsets[i + 1]].tobytes()
                if len(body) >= CHUNK:
                    yield row()
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)


def unpacked(ids: bytes, sizes: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, offsets and bytes of a chunk."""
    n = np.frombuffer(sizes, "<i8")
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return np.frombuffer(ids, "<i8"), offsets, np.frombuffer(pa.decompress(body, decompressed_size=int(offsets[-1]), codec="zstd", asbytes=True), np.uint8)


class Stretches:
    """Of a chunk: doc (its place), start, n (windows), seed_hash, place (where the seed starts) and mark (a hash of the string) of each stretch."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, length: int, gram: int):
        self.data, self.length, self.gram = data, length, gram
        parts: list[tuple[np.ndarray, ...]] = []
        i, docs = 0, len(offsets) - 1
        while i < docs:
            j = i + 1
            while j < docs and offsets[j + 1] - offsets[i] <= SCAN:
                j += 1
            if j == i + 1:  # a document longer than a scan goes in overlapping pieces
                for at in range(int(offsets[i]), max(int(offsets[i + 1]) - length + 1, int(offsets[i])), SCAN):
                    stop = min(at + SCAN + length - 1, int(offsets[i + 1]))
                    parts.append(self._scan(data[at:stop], np.array([0, stop - at]), i, at, length, gram))
            else:
                parts.append(self._scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, int(offsets[i]), length, gram))
            i = j
        columns = zip(*parts, strict=True) if parts else [[np.zeros(0, np.int64)]] * 4 + [[np.zeros(0, np.uint64)]] * 2
        self.doc, self.start, self.n, self.place, self.seed_hash, self.mark = (np.concatenate(c) for c in columns)
        self.seed = (shingles.mixed(self.seed_hash) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    @staticmethod
    def _scan(data: np.ndarray, offsets: np.ndarray, doc: int, at: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
        size = len(data)
        none = np.zeros(0, np.int64)
        if size < length:
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(shingles._TABLE_BYTES[data] * shingles._power(0, size), out=total[1:])
        back = shingles._power(1, size)
        grams = shingles.mixed((total[gram:] - total[:-gram]) * back[: size - gram + 1])
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width, k = length - gram + 1, 1
        while 2 * k <= width:
            key = np.minimum(key[:-k], key[k:])
            k *= 2
        if width > k:
            key = np.minimum(key[: len(key) - (width - k)], key[width - k :])
        place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the seed of the window at each start
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
        valid = np.arange(len(place)) + length <= offsets[1:][owner]
        new = valid.copy()
        new[1:] &= (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        stop = np.flatnonzero(np.append(~valid[1:] | new[1:], True) & valid) + 1
        whole = (total[stop + length - 1] - total[start]) * back[start]
        mark = shingles.mixed(whole + (stop - start).astype(np.uint64))
        return owner[start] + doc, start + at, stop - start, place[start] + at, grams[place[start]], mark

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the strings of two stretches are equal, byte by byte."""
        same = self.n[a] == self.n[b]
        for i in range(0, len(a), COMPARED):
            x = np.flatnonzero(same[i : i + COMPARED]) + i
            n = self.n[a[x]] + self.length - 1
            first = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(first, n)
            equal = self.data[np.repeat(self.start[a[x]], n) + inside] == self.data[np.repeat(self.start[b[x]], n) + inside]
            if len(x):
                same[x] = np.logical_and.reduceat(equal, first)
        return same

    def different(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One stretch of each different string, its number for every stretch, and its least doc_id; the same for each scan of a chunk."""
        order = np.argsort(self.mark, kind="stable")
        if not len(order):
            return order, order, order
        mark = self.mark[order]
        new = np.concatenate([[True], mark[1:] != mark[:-1]])
        again = np.flatnonzero(~new)
        odd = again[~self._same(order[again], order[again - 1])]
        run = np.cumsum(new)
        for k in np.unique(run[odd]):  # one hash of several strings
            at = np.flatnonzero(run == k)
            own: dict[bytes, int] = {}
            which = np.array([own.setdefault(self.data[self.start[i] : self.start[i] + self.n[i] + self.length - 1].tobytes(), len(own)) for i in order[at]])
            by = np.argsort(which, kind="stable")
            order[at], new[at] = order[at][by], np.diff(which[by], prepend=-1) != 0
        first = np.flatnonzero(new)
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        return order[first], number, np.minimum.reduceat(ids[self.doc[order]], first)


def _binary_rows(key: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and its rows, in order."""
    if len(key):
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
        yield from zip(key[order[first]].tolist(), np.split(rows[order], first[1:]), strict=True)


def _modulo(x: np.ndarray, n: int) -> np.ndarray:
    return ((x & np.uint64(0xFFFFFFFF)) % np.uint64(n)).astype(np.int64)


def seeds(chunks: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """bucket, chunk and the chunk's seeds there, each with how many different stretches it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, *packed_row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids, offsets, data = unpacked(*packed_row)
                s = Stretches(offsets, data, length, gram)
                one = s.different(ids)[0]
                bucket = _modulo(s.seed_hash[one], buckets)
                key, n = np.unique(bucket.astype(np.uint64) << np.uint64(32) | s.seed[one], return_counts=True)
                entries = np.empty(len(key), _SEED)
                entries["seed"], entries["n"] = key & np.uint64(0xFFFFFFFF), np.minimum(n, 0xFFFF)
                rows = [(b, chunk, part.tobytes()) for b, part in _binary_rows((key >> np.uint64(32)).astype(np.int64), entries)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "chunk", "entries"])

    return chunks.mapInArrow(run, "bucket long, chunk long, entries binary")


def _unpack(column: pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Records of a binary column, and the row of each."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


ASKED = "chunk long, asked binary, hot binary"


def meet(most: int):
    """A bucket of seeds: for each chunk, those that have more than one stretch in all, and those with more than `most`, which are split."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        e, row = _unpack(table["entries"], _SEED)
        order = np.argsort(e["seed"], kind="stable")
        seed, n, row = e["seed"][order], e["n"][order].astype(np.int64), row[order]
        first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        size = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(seed))))
        asked, hot = (np.flatnonzero(size > least) for least in (1, most))
        split = dict(_binary_rows(row[hot], seed[hot]))
        rows = [(table["chunk"][r].as_py(), own.tobytes(), split[r].tobytes() if r in split else b"") for r, own in _binary_rows(row[asked], seed[asked])]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.table({"chunk": pa.array(columns[0], pa.int64()), "asked": pa.array(columns[1], pa.binary()), "hot": pa.array(columns[2], pa.binary())})

    return run


def _halves(s: Stretches, i: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of some stretches: those (as places in i), first windows, numbers of windows and hashes of two parts each.

    The windows that hold `half` bytes before the seed share these with their
    equals; the others share as many, or one more, after it.
    """
    half = (s.length - s.gram + 1) // 2
    after = s.length - s.gram - half + 1
    before = np.clip(s.place[i] - half - s.start[i] + 1, 0, s.n[i])
    out = []
    for at, n, left, size in ((np.zeros_like(before), before, half, half + s.gram), (before, s.n[i] - before, 0, s.gram + after)):
        some = np.flatnonzero(n > 0)
        text = s.data[(s.place[i[some]] - left)[:, None] + np.arange(size)].astype(np.uint64)
        out.append((some, at[some], n[some], shingles.mixed((text * _SIDES[:size]).sum(1, dtype=np.uint64) + s.seed_hash[i[some]] + np.uint64(left))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def strings(length: int, gram: int, buckets: int):
    """Of a chunk and the seeds asked for: the different stretches' strings, for finer buckets."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("entries", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        asked, hot = (np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in right[c].to_pylist()])) for c in ("asked", "hot"))
        ids, offsets, data = unpacked(*(left[c][0].as_py() for c in ("ids", "sizes", "body")))
        s = Stretches(offsets, data, length, gram)
        one, _, least = s.different(ids)
        some = np.flatnonzero(np.isin(s.seed[one], asked))
        split = np.isin(s.seed[one[some]], hot)
        whole, parts = some[~split], some[split]
        which, at, windows, hashed = _halves(s, one[parts])
        number = np.concatenate([whole, parts[which]])
        at = np.concatenate([np.zeros(len(whole), np.int64), at])
        bucket = _modulo(np.concatenate([shingles.mixed(s.seed_hash[one[whole]] + np.uint64(7)), hashed]), buckets)
        size = np.concatenate([s.n[one[whole]], windows]) + length - 1
        entries = np.empty(len(number), _ENTRY)
        entries["number"], entries["at"], entries["doc"] = number, at, least[number]
        begin = s.start[one[number]] + at
        rows = []
        for b, places in _binary_rows(bucket, np.arange(len(number))):
            n = size[places]
            index = np.repeat(begin[places] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows.append((b, key[0].as_py(), entries[places].tobytes(), n.astype("<u2").tobytes(), data[index].tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def refined(data: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places with at least `length` bytes left in their string, and the final bucket of each: equal buckets, equal strings.

    Buckets by the first q bytes, q = 8 or the greatest power of two within
    `length`, are refined by the bucket identifiers q further on, doubling q;
    the last offset is what is left to `length`.
    """
    q = 8
    while q > length:
        q //= 2
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(data), np.uint64)
    for k in range(q):
        key = key << np.uint64(8) | padded[k : k + len(data)]
    identifier = np.zeros(len(data), np.uint64)
    places = np.flatnonzero(left >= q)
    identifier[places] = np.unique(key[places], return_inverse=True)[1]
    while q < length:
        step = min(q, length - q)
        places = places[left[places] >= q + step]
        pointers = identifier[places] << np.uint64(32) | identifier[places + step]
        identifier[places] = np.unique(pointers, return_inverse=True)[1]
        q += step
    return places, identifier[places]


def compare(length: int):
    """A bucket of strings: for each chunk's string the runs of windows that a smaller document holds, with its doc_id."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        e, row = _unpack(table["entries"], _ENTRY)
        sizes = _unpack(table["sizes"], np.dtype("<u2"))[0].astype(np.int64)
        raw, end = b"".join(table["body"].to_pylist()), np.cumsum(sizes)
        # a string that several chunks hold is sorted once, with its least doc_id
        own: dict[bytes, int] = {}
        number = np.array([own.setdefault(raw[b - n : b], len(own)) for b, n in zip(end.tolist(), sizes.tolist(), strict=True)], np.int64)
        doc = np.full(len(own), NO_ID)
        np.minimum.at(doc, number, e["doc"])
        n = np.fromiter(map(len, own), np.int64, len(own))
        shift = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n)), n)
        left = np.repeat(shift + n, n) - np.arange(n.sum())
        places, bucket = refined(np.frombuffer(b"".join(own), np.uint8), left, length)
        least = np.full(int(bucket.max()) + 1 if len(bucket) else 0, NO_ID)
        np.minimum.at(least, bucket.astype(np.int64), doc[owner[places]])
        found = least[bucket.astype(np.int64)]
        # windows of a string lie together, in order: their first place and number
        windows = n - length + 1
        base = np.cumsum(windows) - windows
        mine = windows[number]
        offset = np.arange(mine.sum()) - np.repeat(np.cumsum(mine) - mine, mine)
        index, who = np.repeat(base[number], mine) + offset, np.repeat(np.arange(len(e)), mine)
        smaller = found[index]
        hit = np.flatnonzero(smaller < e["doc"][who])
        who, offset, smaller = who[hit], offset[hit], smaller[hit]
        start = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (offset[1:] != offset[:-1] + 1) | (smaller[1:] != smaller[:-1])])) if len(hit) else np.zeros(0, np.int64)
        runs = np.empty(len(start), _RUN)
        runs["number"], runs["at"] = e["number"][who[start]], e["at"][who[start]] + offset[start]
        runs["n"], runs["doc"] = np.diff(np.append(start, len(hit))), smaller[start]
        rows = [(table["chunk"][c].as_py(), part.tobytes()) for c, part in _binary_rows(row[who[start]], runs)]
        columns = list(zip(*rows, strict=True)) if rows else [[], []]
        return pa.table({"chunk": pa.array(columns[0], pa.int64()), "runs": pa.array(columns[1], pa.binary())})

    return run


def removed(s: Stretches, ids: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """For each byte of a chunk whether it goes."""
    _, number, least = s.different(ids)
    depth = np.zeros(len(s.data) + 1, np.int32)

    def mark(start: np.ndarray, n: np.ndarray) -> None:
        np.add.at(depth, start, 1)
        np.add.at(depth, start + n + s.length - 1, -1)

    hit = least[number] < ids[s.doc] if len(number) else np.zeros(0, bool)
    mark(s.start[hit], s.n[hit])
    if len(runs):  # least is the doc_id that was compared; what is smaller is so for each stretch of the number
        runs = runs[np.argsort(runs["number"], kind="stable")]
        first, last = (np.searchsorted(runs["number"], number, side) for side in ("left", "right"))
        n = last - first
        which = np.repeat(np.arange(len(number)), n)
        r = runs[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        mark(s.start[which] + r["at"], r["n"].astype(np.int64))
    return np.cumsum(depth[:-1]) > 0


def finish(length: int, gram: int, texts: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("sha256", pa.string()), ("kept", pa.binary())])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        ids, offsets, data = unpacked(*(left[c][0].as_py() for c in ("ids", "sizes", "body")))
        gone = removed(Stretches(offsets, data, length, gram), ids, _unpack(right["runs"], _RUN)[0])
        edge = np.concatenate([gone, [False]]).astype(np.int64)
        rising = np.flatnonzero(edge[:-1] & ~np.concatenate([[0], edge[:-2]]).astype(bool)) if len(data) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(gone)])
        spans = np.searchsorted(rising, offsets)
        raw = data.tobytes()
        rows = []
        for i, doc in enumerate(ids.tolist()):
            a, b = int(offsets[i]), int(offsets[i + 1])
            n = int(total[b] - total[a])
            # a span that goes on from the text before starts anew here
            joined = bool(n and a and gone[a] and gone[a - 1])
            kept = raw[a:b] if not n else data[a:b][~gone[a:b]].tobytes()
            rows.append((None if doc == NO_ID else doc, b - a, n, int(spans[i + 1] - spans[i]) + joined, hashlib.sha256(kept).hexdigest(), hashlib.sha256(raw[a:b]).hexdigest() if texts else None, kept if texts and n else None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, sha256 string, kept binary"


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs; with texts also the hash of the input and, where bytes went, what is left.

    A null text is empty. Rows of one doc_id are compared with smaller ids
    only, so they don't remove each other; a null doc_id counts as the
    greatest. Other columns are not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(size * 2 / (length - gram + 2) / ENTRIES) + 1)
    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed(docs).write.bucketBy(n, "chunk").option("path", path).option("compression", "none").saveAsTable(name)
    asked_at = found_at = None
    try:
        chunks = spark.table(name)
        asked, asked_at = staged_as(seeds(chunks, length, gram, buckets).groupBy("bucket").applyInArrow(meet(HOT), ASKED), "asked")
        weight = asked.agg(F.sum(F.length("asked"))).first()[0] or 0
        finer = max(1, int(weight / 4 * (length + 20) / STRINGS) + 1)
        shapes = "bucket long, chunk long, entries binary, sizes binary, body binary"
        sent = chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(strings(length, gram, finer), shapes)
        found, found_at = staged_as(sent.groupBy("bucket").applyInArrow(compare(length), "chunk long, runs binary"), "runs")
        out = staged(chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish(length, gram, texts), RESULT), "kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for at in (asked_at, found_at):
            if at:
                drop_staged(at)
        delete(spark, path)
    return out


def digest(docs: DataFrame) -> DataFrame:
    return repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut from text; where a cut splits a character, what is left of it goes too. n_chars, where there is one, follows; other columns, rows and null texts stay."""
    cut = repeats(docs, length, texts=True).filter("kept is not null").select(F.col("doc_id").alias("_id"), F.col("sha256").alias("_sha"), "kept").dropDuplicates(["_id", "_sha"])

    @F.pandas_udf("string")
    def readable(x):
        return x.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    own = docs.select(whole.alias("_row"), F.col("doc_id").alias("_own"), F.sha2("text", 256).alias("_text"))
    found = cut.select("_id", "_sha", readable("kept").alias("_new"))
    met = own.join(found, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha")), "left")
    row = F.col("_row").withField("text", F.col("_new"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("_new").cast(docs.schema["n_chars"].dataType))
    return met.select(F.when(F.col("_new").isNull(), F.col("_row")).otherwise(row).alias("_row")).select("_row.*")
