"""Packing by minimum bin slack.

A document's ids are cut into full windows and one rest. How the rests share
windows is planned on the counts of their lengths, at most `window` numbers
whatever the input: the longest length left opens a window, a bitset holds
which sums the other lengths can reach, and the sum with the least slack is
backtracked to counts. A filling is used as often as the counts allow, so the
plan has few rows. A sequence whose length is a power of two needs no padding
and counts as having no slack.

A whole window is a sequence of its own and needs no plan: its row's number
names it, so that it is never ranked or moved. Of the others the plan maps
(length, rank among the pieces of this length) to a sequence and an offset.
Ranks come from a window over (length, salt) and the counts of salts, so no
length, however frequent, lands in one task, and only the counts, at most
window * SALTS, reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import staged

WINDOW = 4096
END = 2
SALTS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(n: int, window: int) -> list[tuple[int, int]]:
    return [(s, min(window, n - s)) for s in range(0, n, window)]


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece; a null or empty text is the end id alone."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.word_bpe(path)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, own in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids = own + last
                n = len(ids) // 4
                rows += [(doc, s, k, zlib.crc32(ids[4 * s : 4 * (s + k)]), n) for s, k in cut(n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


@dataclass
class Plan:
    """Rows of one length take ranks from `first`; `each` of them lie in each sequence, from `offset`."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int
    padding: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) << 45 | self.first
        i = np.searchsorted(key, length.astype(np.int64) << 45 | rank, "right") - 1
        k = rank - self.first[i]
        return self.base[i] + k // self.each[i], self.offset[i] + k % self.each[i] * length


def slack(total: int, window: int) -> int:
    return 0 if total & (total - 1) == 0 else window - total


def fill(left: dict[int, int], order: list[int], opener: int, window: int) -> dict[int, int]:
    """Counts by length of the filling with the least slack that holds opener; the longest such filling.

    order: the lengths in use, descending. The bitset after each part (a
    length times a power of two, so that any count is a sum of parts) is kept
    for backtracking; the search ends as soon as the window can be full.
    """
    room, reach = window - opener, 1
    mask = (1 << room + 1) - 1
    layers: list[tuple[int, int, int]] = []  # length, times, reachable sums before
    for length in order:
        if length > room:
            continue
        most = min(left[length] - (length == opener), room // length)
        times = 1
        while most > 0 and not reach >> room & 1:
            times = min(times, most)
            layers.append((length, times, reach))
            reach |= reach << length * times & mask
            most -= times
            times *= 2
        if reach >> room & 1:
            break
    best, least = 0, slack(opener, window)
    sums = {room, reach.bit_length() - 1} | {(1 << p) - opener for p in range(window.bit_length()) if 1 << p >= opener}
    for s in sorted(sums):
        if 0 <= s <= room and reach >> s & 1 and slack(opener + s, window) <= least:
            best, least = s, slack(opener + s, window)
    counts, s = {opener: 1}, best
    for length, times, before in reversed(layers):
        if not before >> s & 1:
            counts[length] = counts.get(length, 0) + times
            s -= length * times
    assert s == 0
    return counts


def plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """counts: how many pieces have each length from 1 to window."""
    left = {k: v for k, v in counts.items() if v}
    order = sorted(left, reverse=True)
    used = dict.fromkeys(left, 0)
    rows, sequences, padding = [], 0, 0
    while order:
        opener = order[0]
        chosen = fill(left, order, opener, window)
        times = min(left[k] // n for k, n in chosen.items())
        at = 0
        for k, n in sorted(chosen.items(), reverse=True):
            rows.append((k, used[k], n, sequences, at))
            used[k] += n * times
            left[k] -= n * times
            at += k * n
        padding += times * slack(at, window)
        sequences += times
        gone = [k for k in chosen if not left[k]]
        if gone:
            order = [k for k in order if left[k]]
    rows.sort()
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, sequences, padding)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """The pieces with sequence_id and offset: every id of every document in exactly one piece, each sequence gapless from 0. Sequences' numbers differ, but needn't follow each other.

    Rows with a repeated doc_id are packed as documents of their own; an empty
    table gives no rows.
    """
    salted = pieces(docs, path, window, end).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    every = staged(salted, "pieces")
    kept = every.filter(F.col("length") < window)
    counts = kept.groupBy("length", "_salt").count().toPandas().sort_values(["length", "_salt"], ignore_index=True)
    made = plan(counts.groupby("length")["count"].sum().to_dict(), window)
    before = counts.groupby("length")["count"].cumsum() - counts["count"]
    starts = np.zeros((window + 1, SALTS), np.int64)
    starts[counts["length"], counts["_salt"]] = before
    shared = docs.sparkSession.sparkContext.broadcast((made, starts))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, salt: pd.Series, row: pd.Series) -> pd.DataFrame:
        at, begins = shared.value
        size = length.to_numpy()
        sequence, offset = at.place(size, begins[size, salt.to_numpy()] + row.to_numpy() - 1)
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = kept.withColumn("_row", F.expr("row_number() over (partition by length, _salt order by doc_id, start, ids_crc32)"))
    own = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    shared_out = ranked.withColumn("_at", placed("length", "_salt", "_row")).select(*own, "_at.sequence_id", "_at.offset")
    alone = F.lit(made.sequences) + F.monotonically_increasing_id()
    return every.filter(F.col("length") == window).select(*own, alone.alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(shared_out)
