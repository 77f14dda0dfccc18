"""What the corpus operators share: tables, the shared folder, staged tables."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows of a few numbers in a file of a staged table, at most about.
NUMBERS = 1 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())
_staged: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by whatever file system Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one only where it is unset and all run on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _staged:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: nothing to reach the folder with
            return


def drop_staged(df_path: str) -> None:
    """Deletes a staged table that nothing reads any more."""
    for pair in [p for p in _staged if p[1] == df_path]:
        delete(*pair)
        _staged.remove(pair)


def staged_path(spark: SparkSession, name: str) -> str:
    if not _staged:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables staged within are deleted at the end, but for lasting ones, which are the scope's around it."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            drop_staged(path)


def gathered(df: DataFrame, rows: int, each: int = NUMBERS, tasks: int = 1) -> DataFrame:
    """df in as many partitions as `rows`, at most about its own, make with `each` of them, and in `tasks` for each core at least; never in more than it has. Where few rows come out of many partitions, each partition would be written as a file, for which Hadoop starts three processes on a local disk."""
    return df.coalesce(max(tasks * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def staged(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and lost executors cost only a read. It stays until its scope or, without one, the process ends."""
    return staged_as(df, name, lasting)[0]


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within go once they are written; else they stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def staged_as(df: DataFrame, name: str, lasting: bool = False) -> tuple[DataFrame, str]:
    path = staged_path(df.sparkSession, name)
    scopes = _scopes.get()[:-1] if lasting else _scopes.get()
    if scopes:
        scopes[-1].append(path)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
