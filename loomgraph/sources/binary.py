"""Binary edge lists and their descriptors.

Type 1 is (src, dst, weight), type 2 (src, dst), packed and little-endian; ids
have 4 bytes and weights 4 in compact files, 8 and 8 in wide ones. Files are
listed by Spark and read in record-aligned ranges, so one large file spreads
over tasks. Compressed files are zlib streams of the same records; such a
stream can only be read from its start, so each file is one task's, and is
read and written in pieces of bounded size.
"""

from __future__ import annotations

import configparser
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import EDGE_SCHEMA, Graph

RANGE = 32 << 20
#: Bytes of a compressed file read at once, and those made of them.
PIECE = 4 << 20
_NAMES = ["src", "dst", "weight"]


def record(kind: int, wide: bool = False) -> np.dtype:
    if kind not in (1, 2):
        raise ValueError(f"edge lists have type 1 or 2, not {kind}")
    ids, weight = ("<u8", "<f8") if wide else ("<u4", "<f4")
    return np.dtype([("src", ids), ("dst", ids), *([("weight", weight)] if kind == 1 else [])])


def _read(path: str, offset: int, length: int) -> bytes:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read_at(length, offset)


def read_edges(spark: SparkSession, path: str, kind: int = 1, wide: bool = False) -> DataFrame:
    """src, dst and weight (null in type 2). Ids above 2^63 - 1 and files with part of a record are refused."""
    form = record(kind, wide)
    step = RANGE // form.itemsize * form.itemsize
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.expr(f"if(length = 0, cast(array() as array<bigint>), sequence(0L, length - 1, {step}L))")
    ranges = files.select("path", "length", F.explode(starts).alias("offset")).repartition("path", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, offset in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if length % form.itemsize:
                    raise ValueError(f"{name} has {length} bytes, which isn't a number of records of {form.itemsize}")
                rows = np.frombuffer(_read(name, offset, min(step, length - offset)), form)
                yield _columns(rows, kind, wide, name)

    return ranges.mapInArrow(read, EDGE_SCHEMA)


def _columns(rows: np.ndarray, kind: int, wide: bool, name: str) -> pa.RecordBatch:
    if wide and len(rows) and max(rows["src"].max(), rows["dst"].max()) > np.iinfo(np.int64).max:
        raise ValueError(f"{name} has ids above 2^63 - 1")
    weight = pa.array(rows["weight"].astype(np.float64)) if kind == 1 else pa.nulls(len(rows), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(rows["src"].astype(np.int64)), pa.array(rows["dst"].astype(np.int64)), weight], _NAMES)


def read_compressed(spark: SparkSession, path: str, kind: int = 1, wide: bool = False) -> DataFrame:
    """src, dst and weight of edge lists that are zlib streams, one or several after each other in a file. A stream that ends early, and part of a record, are refused."""
    form = record(kind, wide)
    files = spark.read.format("binaryFile").load(path).select("path").repartition("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(name)
                held, stream, fresh = b"", zlib.decompressobj(), True
                with store.open_input_stream(at) as f:
                    rest = b""
                    while more := rest or f.read(PIECE):
                        out, fresh = stream.decompress(more, PIECE), False
                        rest = stream.unconsumed_tail
                        if stream.eof:
                            rest, stream, fresh = stream.unused_data, zlib.decompressobj(), True
                        held += out
                        whole = len(held) // form.itemsize * form.itemsize
                        yield _columns(np.frombuffer(held[:whole], form), kind, wide, name)
                        held = held[whole:]
                if held or not fresh:
                    raise ValueError(f"{name} ends within a {'record' if held else 'stream'}")

    return files.mapInArrow(read, EDGE_SCHEMA)


def write_edges(edges: DataFrame, path: str, kind: int = 1, wide: bool = False, compressed: bool = False) -> int:
    """Writes a part file a task into the folder and returns the number of edges; the parts' bytes after each other are one edge list, and compressed, a list of zlib streams."""
    form = record(kind, wide)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        store.create_dir(name)
        part, n = f"{name}/part-{TaskContext.get().partitionId():05d}.bin", 0
        with store.open_output_stream(f"{part}.{TaskContext.get().taskAttemptId()}") as f:
            squeeze = zlib.compressobj() if compressed else None
            for batch in batches:
                rows = np.empty(batch.num_rows, form)
                for i, c in enumerate(form.names):
                    rows[c] = batch.column(i).to_numpy(zero_copy_only=False)
                f.write(squeeze.compress(rows.tobytes()) if squeeze else rows.tobytes())
                n += len(rows)
            if squeeze:
                f.write(squeeze.flush())
        store.move(f"{part}.{TaskContext.get().taskAttemptId()}", part)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return edges.select(*_NAMES).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_descriptor(text: str) -> dict:
    """type, name, vertices and edges of an INI descriptor's text."""
    ini = configparser.ConfigParser()
    ini.read_string(text)
    g = ini["graph"]
    return {"type": int(g["type"]), "name": g["name"], "vertices": int(g["vertices"]), "edges": int(g["edges"])}


def descriptor(name: str, kind: int, vertices: int, edges: int) -> str:
    return f"[graph]\ntype={kind}\nname={name}\nvertices={vertices}\nedges={edges}\n"


def read_graph(spark: SparkSession, ini_path: str, wide: bool = False, compressed: bool = False) -> Graph:
    """The graph of a descriptor; its edges are in the file or folder of its name beside it."""
    text = "\n".join(r.value for r in spark.read.text(ini_path).collect())
    d = read_descriptor(text)
    read = read_compressed if compressed else read_edges
    return Graph(read(spark, f"{ini_path.rsplit('/', 1)[0]}/{d['name']}", d["type"], wide), d["vertices"])


def write_graph(graph: Graph, folder: str, name: str, kind: int = 1, wide: bool = False, compressed: bool = False) -> str:
    """Writes the edges and the descriptor beside them; returns the descriptor's path."""
    from pyarrow import fs

    n = write_edges(graph.edges, f"{folder}/{name}", kind, wide, compressed)
    store, at = fs.FileSystem.from_uri(f"{folder}/{name}.ini")
    with store.open_output_stream(at) as f:
        f.write(descriptor(name, kind, graph.num_vertices, n).encode())
    return f"{folder}/{name}.ini"
