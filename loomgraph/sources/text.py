"""Text formats: readers give src, dst and weight; where a format has no weights they are drawn evenly by a hash of the line, the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..gen.graphs import uniform


def _lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    rows = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")
    return rows.filter(~F.col("value").startswith(comment))


def _both(edges: DataFrame, wanted: bool) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")) if wanted else edges


def _field(i: int) -> Column:
    return F.get(F.split("value", r"\s+"), F.lit(i))


def _weight(seed: int) -> Column:
    return uniform(seed, F.col("src"), F.col("dst")).alias("weight")


def matrix_market(spark: SparkSession, path: str, weighted: bool = False, seed: int = 0) -> tuple[DataFrame, dict]:
    """Edges of a coordinate file, or of a folder whose part with the header may be any, ids from 0, and the size line (rows, columns, entries): the first line after the header that isn't a comment."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n")).filter("value <> ''")
    head = lines.groupBy("file").agg(F.count_if(F.col("value").startswith("%%")).alias("heads"), F.min(F.when(~F.col("value").startswith("%"), F.struct("n", "value"))).alias("size"))
    size = head.orderBy(F.desc("heads"), "file").first()["size"]
    rows, columns, entries = (int(x) for x in size.value.split()[:3])
    body = lines.filter(~F.col("value").startswith("%") & (F.col("n") != size.n))
    ends = body.select((_field(0).cast("long") - 1).alias("src"), (_field(1).cast("long") - 1).alias("dst"), _field(2).cast("double").alias("weight"))
    return (ends if weighted else ends.select("src", "dst", _weight(seed))), {"rows": rows, "columns": columns, "entries": entries}


def snap(spark: SparkSession, path: str, both_ways: bool = True, seed: int = 0) -> DataFrame:
    """Two ids a line, # before comments; by default each edge's reverse is added."""
    ends = _lines(spark, path, "#").select(_field(0).cast("long").alias("src"), _field(1).cast("long").alias("dst"))
    return _both(ends.select("src", "dst", _weight(seed)), both_ways)


def twitter(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """Two ids from 1 a line, % before comments."""
    ends = _lines(spark, path, "%").select((_field(0).cast("long") - 1).alias("src"), (_field(1).cast("long") - 1).alias("dst"))
    return ends.select("src", "dst", _weight(seed))


def adjacency(spark: SparkSession, path: str, both_ways: bool = True, seed: int = 0) -> DataFrame:
    """A vertex, a field that is skipped, and its neighbours on a line."""
    parts = _lines(spark, path, "#").select(F.split("value", r"\s+").alias("p"))
    ends = parts.select(F.get("p", F.lit(0)).cast("long").alias("src"), F.explode(F.expr("cast(slice(p, 3, greatest(0, size(p) - 2)) as array<bigint>)")).alias("dst"))
    return _both(ends.select("src", "dst", _weight(seed)), both_ways)


def ratings(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """Rating files, one an item: a line `item:`, then lines `user,rating,date`. Returns the edges both ways, and how many users and items there are.

    Users become 0, 1, … in the order of their ids, items follow. Dense
    numbers come from counts of ranges of ids, so no single task numbers all.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).filter("trim(value) <> ''")
    items = lines.filter("value like '%:'").select("file", F.expr("cast(replace(trim(value), ':') as bigint)").alias("item"))
    votes = lines.filter("value not like '%:'").select("file", F.expr("cast(split(value, ',')[0] as bigint)").alias("user"), F.expr("cast(split(value, ',')[1] as double)").alias("weight"))
    met = votes.join(items, "file").select("user", "item", "weight")
    users, n_users = dense_ids(met.select(F.col("user").alias("key")))
    wares, n_items = dense_ids(met.select(F.col("item").alias("key")))
    ends = met.join(users.toDF("user", "src"), "user").join(wares.toDF("item", "_i"), "item").select("src", (F.col("_i") + n_users).alias("dst"), "weight")
    return _both(ends, True), n_users, n_items


def dense_ids(keys: DataFrame, width: int = 1 << 16) -> tuple[DataFrame, int]:
    """key and id from 0 in the order of whole-number keys, and how many: ranks within ranges of `width` keys, plus the counts of the ranges before."""
    distinct = keys.distinct().withColumn("_range", F.expr(f"key div {width}"))
    counts = distinct.groupBy("_range").count().withColumn("_before", F.expr("sum(count) over (order by _range) - count"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    placed = distinct.withColumn("_rank", F.expr("row_number() over (partition by _range order by key) - 1")).join(counts, "_range")
    return placed.select("key", (F.col("_rank") + F.col("_before")).alias("id")), total


def write_matrix_market(edges: DataFrame, rows: int, columns: int, path: str) -> None:
    """A header part and the entries, ids from 1, as text parts in the folder."""
    n = edges.count()
    head = edges.sparkSession.createDataFrame([(f"%%MatrixMarket matrix coordinate real general\n{rows} {columns} {n}",)], "value string").coalesce(1)
    body = edges.select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, "weight").alias("value"))
    head.unionByName(body).write.text(path)


def write_pegasus(edges: DataFrame, path: str) -> None:
    """src, a tab and dst on each line."""
    edges.select("src", "dst").write.option("sep", "\t").csv(path)
