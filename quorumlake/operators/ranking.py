"""Ranks within groups: top N, shares, winners, ordinals, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], n: int | Column, *order: Column) -> DataFrame:
    """The first n rows of each key; `order` should be total, else equal rows are in no order. Spark keeps n rows per task
    before the shuffle (a group limit), so a hot key is cut down where it lies."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def numbered(df: DataFrame, keys: list[str], out: str, *order: Column) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def share_of_group(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """`out`: 100 * value / sum within keys as decimal(5,2); null where the sum is 0 or null. The sums are aggregated and
    joined back, so no group is gathered in one task."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    return df.join(sums, keys).withColumn(out, F.try_divide(F.col(value) * F.lit(100).cast("decimal(20,6)"), F.col("_sum")).cast("decimal(5,2)")).drop("_sum")


def winners(df: DataFrame, keys: list[str], value: str, tie: str, out: str) -> DataFrame:
    """`out`: whether the row has the greatest `value` of its keys, of equal ones the least `tie`. Null values never win."""
    best = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(F.struct(F.col(value), (-F.col(tie)).alias("t"))).alias("_b"))
    return df.join(best.select(*keys, (-F.col("_b.t")).alias("_w")), keys, "left").withColumn(out, F.coalesce(F.col(tie) == F.col("_w"), F.lit(False))).drop("_w")


def page_of(df: DataFrame, per_page: int, *order: Column, keys: list[str]) -> DataFrame:
    """`position` from 0 and `page` from 1 within keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w) - 1).withColumn("page", F.floor(F.col("position") / per_page) + 1)
