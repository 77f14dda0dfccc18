"""Driver loops: what every iterative operator shares.

A loop's state is checkpointed each round, to the folder in
spark.checkpoint.dir, so plans don't grow and a lost executor costs a read.
checkpoint() keeps the partitioning, so state that is joined by id stays put
and only messages move. It also keeps Spark's estimate of the size, which a
join multiplies: joined with itself each round, a state of some rows gets an
estimate with millions of digits, and planning never ends. So once in some
rounds, when the estimate is long, the state is written as a table and read
back, which has its true size.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Out-edges of a vertex, up to which they stay in one task.
HUB = 1 << 20
#: Rows of a partition that is dealt out.
ROWS = 1 << 20
#: Bits of an estimated size from which a state is written as a table.
LONGEST = 1024
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_passing: contextvars.ContextVar[list[tuple[SparkSession, str]] | None] = contextvars.ContextVar("passing", default=None)


class NotConverged(RuntimeError):
    """A loop reached its last permitted round with work left."""


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and all run on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the session's folder; sets the shared one where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing to reach the folder with
            return


def _estimate_bits(df: DataFrame) -> int:
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is cut within goes at the end, and shuffle files go once they are read; nothing made within may be read after."""
    before, own = spark.conf.get(_CLEANUP, None), []
    token = _passing.set(own)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        _passing.reset(token)
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        for pair in own:
            _delete(*pair)


def drop(df: DataFrame) -> None:
    """Deletes what cut wrote for df within passing(), where nothing reads it any more; else it stays until the driver collects its garbage."""
    own, path = _passing.get(), getattr(df, "_cut_to", None)
    for pair in [p for p in own or () if p[1] == path]:
        _delete(*pair)
        own.remove(pair)


def _checkpoint(df: DataFrame) -> DataFrame:
    out, own = df.checkpoint(eager=True), _passing.get()
    if own is not None:
        out._cut_to = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
        own.append((df.sparkSession, out._cut_to))
    return out


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """df computed once, with its lineage cut; dealt: how it is dealt out and sorted stays known."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    if _estimate_bits(df) <= LONGEST:
        adaptive = spark.conf.get("spark.sql.adaptive.enabled")
        if not dealt or adaptive != "true":
            return _checkpoint(df)
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that adapts doesn't tell a checkpoint its partitioning
        try:
            return _checkpoint(df)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    out, own = spark.read.schema(df.schema).parquet(path), _passing.get()
    if own is not None:
        out._cut_to = path
        own.append((spark, path))
    return out


def tasks(df: DataFrame) -> int:
    """Partitions for df, so that what a task holds doesn't grow with it; the session's number at least. It counts the rows of what isn't computed yet, too."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))


def by(df: DataFrame, key: str, distinct: bool = False) -> DataFrame:
    """df dealt out and sorted by key, once, for all rounds of a loop; distinct: each row once, found in place."""
    out = df.repartition(tasks(df), key)
    return cut((out.distinct() if distinct else out).sortWithinPartitions(key), dealt=True)


class Dealt:
    """Edges dealt out by src, once, for all rounds of a loop.

    The out-edges of a vertex lie in one task, which joins them in place with
    that vertex's row. Those of a hub would be a task that grows with it: they
    are cut into parts by dst, and only a hub's row is copied to its parts.
    """

    def __init__(self, edges: DataFrame, distinct: bool = False):
        dealt = by(edges, "src", distinct)
        degree = dealt.groupBy("src").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HUB)
        self.hubs: DataFrame | None = cut(degree.select("src", F.ceil(F.col("_n") / HUB).alias("_parts")))
        if self.hubs.isEmpty():
            self.hubs, self.edges = None, dealt
        else:
            parted = dealt.join(self.hubs, "src", "left").withColumn("_part", F.pmod(F.xxhash64("dst"), F.coalesce("_parts", F.lit(1))))
            self.edges = cut(parted.drop("_parts").repartition(tasks(dealt), "src", "_part").sortWithinPartitions("src", "_part"), dealt=True)

    def met(self, rows: DataFrame) -> DataFrame:
        """The edges with the columns of rows (src, …), where src has a row."""
        if self.hubs is None:
            return self.edges.join(rows, "src")
        last = F.coalesce("_parts", F.lit(1)).cast("long") - 1
        copied = rows.join(self.hubs, "src", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        return self.edges.join(copied.drop("_parts"), ["src", "_part"]).drop("_part")
