"""Table operators beside a flow's row operators: joins, groups, windows, sets and top-k over whole tables.

Extensions: they name Spark's own operators so that a flow's tables can be prepared and its results summed up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, list(on), how)


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """left with the right side's latest value at or before its time, per key: one union, one window, no range join."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(by, time, F.col(value).alias("_value")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(order)).filter("_side = 1").drop("_side", "_value")


def group(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column], **aggregates: Column) -> DataFrame:
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[a.over(frame).alias(n) for n, a in aggregates.items()])


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """base with the rows of changes in place of those of equal keys (a keyed union)."""
    return base.join(changes.select(*key), list(key), "left_anti").unionByName(changes)
