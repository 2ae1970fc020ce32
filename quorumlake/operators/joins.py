"""Joins that the plain join API doesn't name: point in range, latest row, first match of a cascade, bridge containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_range(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, on: list[str] | None = None, bucket_days: int = 366, how: str = "inner") -> DataFrame:
    """Points with the ranges that contain them; both ends belong to the range, a null end is open.

    With `on` it is an equi-join with the range as a rest condition. Without, each range is put into every bucket of
    `bucket_days` days it touches (an open end up to the last bucket of any point), so it is an equi-join on the bucket and
    never a nested loop. Points without a date and ranges without a start match nothing; `how` may be inner or left. A day
    on which two ranges meet gives both."""
    inside = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) <= F.col(end)))
    if on:
        return points.join(ranges, [points[c] == ranges[c] for c in on] + [inside], how).drop(*[ranges[c] for c in on])
    number = lambda c: F.floor(F.datediff(c, F.lit("1600-01-01").cast("date")) / bucket_days).cast("int")
    last = points.agg(F.max(number(F.col(at))).alias("_top"))  # one row
    spread = (
        ranges.filter(F.col(start).isNotNull())
        .crossJoin(F.broadcast(last))
        .withColumn("_hi", F.when(F.col(end).isNull(), F.col("_top")).otherwise(F.least(number(F.col(end)), F.col("_top"))))
        .withColumn("_lo", number(F.col(start)))
        .filter("_lo <= _hi")
        .withColumn("_bucket", F.explode(F.sequence("_lo", "_hi")))
        .drop("_top", "_lo", "_hi")
    )
    return points.withColumn("_pb", number(F.col(at))).join(spread, (F.col("_pb") == F.col("_bucket")) & inside, how).drop("_pb", "_bucket")


def merged(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, start, end of the disjoint ranges that cover the days of each key's ranges; a null end is open, ranges without a
    start hold no day. So a day lies in at most one range of a key."""
    far = F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))
    real = ranges.filter(F.col(start).isNotNull()).withColumn("_e", far).filter(F.col(start) <= F.col("_e"))
    w = Window.partitionBy(key).orderBy(start, "_e")
    before = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = real.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    open_end = F.when(F.bool_or(F.col(end).isNull()), F.lit(None).cast("date")).otherwise(F.max("_e"))
    return runs.groupBy(key, "_run").agg(F.min(start).alias(start), open_end.alias("_last")).select(key, start, F.col("_last").alias(end))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in `order` (J9, J10, W3): one sort within the key, pre-aggregation isn't possible for rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_value(df: DataFrame, keys: list[str], rank: list[str], values: list[str]) -> DataFrame:
    """`values` of the row greatest by `rank` in each key, by a partial aggregate: one row per key and task is shuffled."""
    pick = F.max(F.struct(*rank, *[F.col(v).alias(f"_v_{v}") for v in values]))
    return df.groupBy(*keys).agg(pick.alias("_k")).select(*keys, *[F.col(f"_k._v_{v}").alias(v) for v in values])


def first_match(df: DataFrame, key: str, lookups: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """key, value, stage, candidates: the cascade of J16. `lookups` are (table, columns) from the strictest to the loosest;
    df is joined to each on its columns, the first stage with any match decides, and a stage that matches several values is
    an error, given as candidates > 1 with a null value. Rows no stage matches come out with stage null."""
    found = None
    for k, (table, cols) in enumerate(lookups):
        got = df.select(key, *cols).join(table.select(*cols, value), cols).groupBy(key).agg(
            F.countDistinct(value).alias("candidates"), F.min(value).alias(value)
        ).withColumn("stage", F.lit(k))
        found = got if found is None else found.unionByName(got)
    best = latest(found, [key], F.asc("stage"))
    best = best.withColumn(value, F.when(F.col("candidates") == 1, F.col(value)))
    return df.select(key).join(best, key, "left")


def follow(start: DataFrame, links: DataFrame, node: str, to: str, most: int = 8) -> DataFrame:
    """`node` and the end of its chain of links (J24), at most `most` steps; the bound also ends circles."""
    cur = start.select(node, F.col(node).alias("_at"))
    hop = links.select(F.col(node).alias("_f"), F.col(to).alias("_t"))
    for _ in range(most):
        cur = cur.join(hop, F.col("_at") == F.col("_f"), "left").select(node, F.coalesce("_t", "_at").alias("_at"))
    return cur.withColumnRenamed("_at", "target")


def cached_lookup(asked: DataFrame, cache: DataFrame, outside: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(key, value, source of what was asked; the cache with what was found outside it), S24: the cache decides, another table
    is asked for what it lacks only, and what that has is cached."""
    missing = asked.select(key).distinct().join(cache.select(key), key, "left_anti")
    found = missing.join(outside.select(key, value), key)
    full = cache.select(key, value).withColumn("source", F.lit("cache")).unionByName(found.withColumn("source", F.lit("outside")))
    return asked.select(key).distinct().join(full, key, "left"), full.select(key, value)
