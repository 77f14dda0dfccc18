"""Feeds a graph's edges to a stream: files in a folder, some a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "src long, dst long"


#: Edges of a file.
ROWS = 1 << 20


def feed(edges: DataFrame, folder: str, batches: int = 4) -> int:
    """Writes the edges as files for up to `batches` micro-batches; returns how many files are one, so that none grows with the edges."""
    files = max(1, -(-edges.count() // (batches * ROWS)))
    part = F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.lit(batches * files))
    edges.select("src", "dst").repartition(batches * files, part).write.parquet(folder)
    return files


def stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The folder's edges as a stream, so many files a micro-batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
