"""Connected components of a stream of edges.

Each micro-batch is merged with the labels so far: its edges and the labels'
links (vertex, component) stand for all earlier edges, so the history is
never read again. Labels are written by batch id, and a batch that is replayed
overwrites its own version from the version before it: results are the same
after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..graph import Graph
from ..operators.components import least_reaching
from ..plans.loop import Dealt


def _labels(spark: SparkSession, state: str, batch: int, num_vertices: int) -> DataFrame:
    """The labels before a batch: those of the greatest earlier version."""
    versions = versions_of(spark, state)
    earlier = [b for b in versions if b < batch]
    if not earlier:
        return spark.range(num_vertices).select("id", F.col("id").alias("component"))
    return spark.read.parquet(f"{state}/batch={max(earlier)}")


def versions_of(spark: SparkSession, state: str) -> list[int]:
    """The batches whose labels are complete."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(state)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    names = [x.getPath().getName() for x in store.listStatus(root)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch=") and store.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS")))


def merge(edges: DataFrame, labels: DataFrame, num_vertices: int) -> DataFrame:
    """Labels (id, component) after some more edges: components of the old components' graph, then one lookup a vertex."""
    old_a, old_b = labels.toDF("src", "_a"), labels.toDF("dst", "_b")
    between = edges.select("src", "dst").join(old_a, "src").join(old_b, "dst").filter("_a <> _b").select(F.col("_a").alias("src"), F.col("_b").alias("dst")).distinct()
    both = Dealt(Graph(between.withColumn("weight", F.lit(None).cast("double")), num_vertices).both_ways().edges.select("src", "dst").distinct())
    touched = both.edges.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("component"))
    new = least_reaching(both, touched).toDF("component", "_new")
    return labels.join(new, "component", "left").select("id", F.coalesce("_new", "component").alias("component"))


def online_cc(edges: DataFrame, state: str, num_vertices: int) -> DataStreamWriter:
    """A stream writer that keeps labels under `state`; start it, then read labels()."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        out = merge(df, _labels(spark, state, number, num_vertices), num_vertices)
        out.write.mode("overwrite").parquet(f"{state}/batch={number}")
        store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
        fs = store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for old in versions_of(spark, state):
            if old < number - 1:
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/batch={old}"), True)

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/progress")


def labels(spark: SparkSession, state: str, num_vertices: int) -> DataFrame:
    """vertex and component after the last batch."""
    return _labels(spark, state, 1 << 62, num_vertices).withColumnRenamed("id", "vertex")
