"""Aggregates that vertex programs gather with: all combine before the shuffle and don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_by(*order: str | Column) -> Column:
    """The least tuple of columns, compared from the left; its fields are taken by name."""
    return F.min(F.struct(*order))


def greatest_by(value: str, order: str, tie: str) -> Column:
    """value of the row with the greatest order; of equals, of the row with the least tie."""
    return F.max_by(value, F.struct(F.col(order), -F.col(tie)))


def any_of(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def sum_at_least(df: DataFrame, key: str, order: str, value: str, out: str = "total", tolerance: float = 0.0) -> DataFrame:
    """key, the least order of each, and the sum of value over the rows within tolerance of it: two aggregations, since the least isn't known before."""
    least = df.groupBy(key).agg(F.min(order).alias("_least"))
    met = df.join(least, key).filter(F.col(order) - F.col("_least") <= tolerance)
    return met.groupBy(key).agg(F.first("_least").alias(order), F.sum(value).alias(out))
