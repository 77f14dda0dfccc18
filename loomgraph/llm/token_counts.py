"""Token counts by a separator scan over flat, unindexed token streams.

A stream is a run of ids with an end-of-document id after each document and
nothing else: a token file. It is read in blocks that know nothing of
documents. Within a block one vectorised comparison finds the separators. Each
block then needs only the tokens that earlier blocks left open, which a prefix
scan over one summary row per block gives: the running total minus the running
total at the last separator before the block. The scan has two levels, within
spans of blocks and over the spans, so that a stream of any length spreads
over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import staged

SEPARATOR = 50256
BLOCK = 1 << 16
#: Blocks in a span.
SPAN = 1 << 10
#: Stands for a null doc_id within a stream.
NO_ID = -(1 << 63)
BLOCKS = "stream string, block long, ids binary, docs binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_streams(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """Token streams of documents, one a task, as blocks of `block` two-byte ids that cut anywhere.

    docs: the doc_ids of the documents that end in the block, in order. A null
    text is empty: its separator alone.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokens.byte_bpe(path)
        stream, number = f"part-{TaskContext.get().partitionId():07d}", 0
        held: list[np.ndarray] = []
        ends: list[tuple[int, int | None]] = []  # place of a separator after the last block, and its document
        size = 0

        def cut(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, ends, size, number
            if size < block and not (all_of_it and size):
                return
            flat = np.concatenate(held)
            upto = size if all_of_it else size - size % block
            k = 0
            for at in range(0, upto, block):
                stop, own = min(at + block, upto), []
                while k < len(ends) and ends[k][0] < stop:
                    own.append(NO_ID if ends[k][1] is None else ends[k][1])
                    k += 1
                row = [[stream], [number], [flat[at:stop].tobytes()], [np.array(own, "<i8").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["stream", "block", "ids", "docs"])
                number += 1
            held, ends, size = [flat[upto:]], [(p - upto, d) for p, d in ends[k:]], size - upto

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoding.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype("<u2")
                held += [ids, np.array([separator], "<u2")]
                size += len(ids) + 1
                ends.append((size - 1, doc))
                if size >= block:
                    yield from cut(False)
        yield from cut(True)

    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS)


def token_files(spark: SparkSession, pattern: str, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Blocks of raw token files: flat ids of `dtype`, no header and no index.

    The files are listed through Spark's file systems. Each block is read by
    offset and length, so a file of any size spreads over tasks.
    """
    width = np.dtype(dtype).itemsize
    sizes = spark.read.format("binaryFile").load(pattern).select("path", "length")
    step = block * width
    starts = sizes.select("path", F.explode(F.expr(f"if(length = 0, cast(array() as array<bigint>), sequence(0L, cast((length - 1) div {step} as bigint)))")).alias("block"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    raw = f.read_at(step, number * step)
                row = [[path], [number], [np.frombuffer(raw[: len(raw) // width * width], dtype).astype("<u4").tobytes()], [None]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["stream", "block", "ids", "docs"])

    return starts.repartition("path", "block").mapInArrow(read, BLOCKS)


def scan(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """A row for each document: stream, ordinal in it, doc_id where the blocks tell it, and n_tokens without the separator.

    Tokens after a stream's last separator are a document too, with ended
    false; nothing follows an empty stream.
    """
    found = "stream string, block long, n long, tail long, lengths array<long>, docs array<long>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stream, number, ids, docs in zip(*(batch.column(i) for i in range(4)), strict=True):
                flat = np.frombuffer(ids.as_buffer(), dtype)
                at = np.flatnonzero(flat == separator)
                lengths = np.diff(at, prepend=-1) - 1
                tail = len(flat) - (at[-1] + 1 if len(at) else 0)
                rows.append((stream.as_py(), number.as_py(), len(flat), int(tail), lengths, np.frombuffer(docs.as_buffer(), "<i8") if docs.is_valid else np.zeros(0, "<i8")))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["stream", "block", "n", "tail", "lengths", "docs"])

    own = staged(blocks.mapInArrow(search, found).withColumn("span", F.expr(f"block div {SPAN}")), "found")
    # within spans: what lies before a block, and where the last separator before it is
    inside = "over (partition by stream, span order by block rows between unbounded preceding and 1 preceding)"
    within = own.selectExpr("*", f"coalesce(sum(n) {inside}, 0L) as _at", f"coalesce(sum(size(lengths)) {inside}, 0L) as _ends")
    within = within.selectExpr("*", "if(size(lengths) > 0, _at + n - tail, null) as _mark").selectExpr("*", f"max(_mark) {inside} as _since")
    # of spans: the same, from one row each
    span = within.groupBy("stream", "span").agg(F.sum("n").alias("_n"), F.sum(F.size("lengths")).alias("_k"), F.max("_mark").alias("_m"), F.max("block").alias("_b"))
    earlier = "over (partition by stream order by span rows between unbounded preceding and 1 preceding)"
    span = span.selectExpr("*", f"coalesce(sum(_n) {earlier}, 0L) as _from", f"coalesce(sum(_k) {earlier}, 0L) as _before", "max(_b) over (partition by stream) as _end")
    span = span.selectExpr("stream", "span", "_before", "_end", f"_from - coalesce(max(_from + _m) {earlier}, 0L) as _held")
    # what is open at the start of a block: the tokens since the last separator before it
    open_ = within.join(span, ["stream", "span"]).selectExpr("*", "_before + _ends as _ordinal", "if(_since is null, _held + _at, _at - _since) as _open", "block = _end as _last")
    pieces = open_.selectExpr(
        "stream",
        "_ordinal",
        "docs",
        "_open",
        "if(_last and if(size(lengths) > 0, tail, tail + _open) > 0, concat(lengths, array(tail)), lengths) as lengths",
        "size(lengths) as _ended",
    )
    rows = pieces.selectExpr("stream", "_ordinal", "docs", "_open", "_ended", "posexplode(lengths) as (_i, _n)")
    return rows.selectExpr("stream", "_ordinal + _i as ordinal", f"nullif(get(docs, _i), cast('{NO_ID}' as bigint)) as doc_id", "_n + if(_i = 0, _open, 0L) as n_tokens", "_i < _ended as ended")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens of every document, from its stream. A null text is empty; rows that repeat an id have a row each; other columns are not read."""
    return scan(token_streams(docs)).select("doc_id", "n_tokens")
