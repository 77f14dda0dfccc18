"""Graphs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph, from_edges
from .plans.loop import tasks


def consecutive(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """src, dst and weight: from each event's user to the next one's by (ts, event_id).

    Ranks are taken within buckets of time; only the first event of each
    bucket, a small table, is ordered as a whole to link the buckets.
    """
    e = events.select("ts", "event_id", "user_id", "value", F.date_trunc(bucket, "ts").alias("_b"))
    inside = e.withColumn("_next", F.expr("lead(user_id) over (partition by _b order by ts, event_id)"))
    firsts = e.groupBy("_b").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("_first"))
    links = firsts.select("_b", F.expr("lead(_first) over (order by _b)").alias("_after"))
    met = inside.join(links, "_b")
    return met.select(F.col("user_id").alias("src"), F.coalesce("_next", "_after").alias("dst"), F.col("value").alias("weight")).filter("dst is not null")


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _users(events: DataFrame) -> int:
    return (events.agg(F.max("user_id")).first()[0] or 0) + 1


def user_flow(spark: SparkSession, d: str) -> Graph:
    events = _read(spark, d, "events")
    return from_edges(consecutive(events), _users(events))


def purchase_flow(spark: SparkSession, d: str) -> Graph:
    events = _read(spark, d, "events")
    return from_edges(consecutive(events.filter("event_type = 'purchase'")), _users(events))


def _trade(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    return _read(spark, d, "lineitem"), _read(spark, d, "part").count(), _read(spark, d, "supplier").count()


def ratings(spark: SparkSession, d: str) -> Graph:
    lines, parts, suppliers = _trade(spark, d)
    dealt = lines.repartition(tasks(lines), "l_partkey", "l_suppkey")  # else a task's groups grow with the table
    mean = dealt.groupBy("l_partkey", "l_suppkey").agg(F.avg("l_quantity").alias("weight"))
    return from_edges(mean.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + parts).alias("dst"), "weight"), parts + suppliers).both_ways()


def likelihoods(graph: Graph) -> Graph:
    """Weights between 0.1 and 0.9 by the ends, for belief propagation."""
    w = 0.1 + 0.8 * (F.pmod(F.col("src") * 31 + F.col("dst") * 17, F.lit(97)) / 97.0)
    return Graph(graph.edges.withColumn("weight", w), graph.num_vertices)
