"""Tables of a data folder, and the rule for repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.session import written

#: Superseded rows that are sent to every task, some 20 bytes each; beyond that they are joined by a shuffle.
SENT = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` as stored; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, key: str | list[str], *latest: Column) -> DataFrame:
    """One row per key. Redelivered rows count once; where they differ, the row greatest by `latest` and then by all
    other columns is kept, so the choice doesn't depend on the order of arrival. Aggregates before it shuffles.
    Null keys form one group, as in GROUP BY."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ordered = F.struct(*[x.alias(f"_o{i}") for i, x in enumerate(latest)], *[F.col(f"`{c}`") for c in rest])
    got = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max(ordered).alias("_kept"))
    return got.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_kept.`{c}`").alias(c) for c in df.columns])


def current_rows(df: DataFrame, key: str, latest: str, *cols: str) -> DataFrame:
    """`key` and `cols` of one row per key of a table read from files: that of the greatest `latest`, of equal ones the one
    greatest by `cols`. The same as `once`, for wide rows of which few are sent again.

    Only keys and `latest` are shuffled to find keys with several rows; of those the superseded rows are told by their place
    in their file and left out of the scan, so texts aren't shuffled. How many they are is counted before they are sent to
    every task."""
    at = df.select("*", F.xxhash64("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    several = df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_k"))
    rows = at.select(key, latest, "_f", "_r", *cols).join(several, F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    order = [F.desc_nulls_last(latest), *[F.desc_nulls_last(c) for c in cols], F.asc("_f"), F.asc("_r")]
    old = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n > 1").select("_f", "_r")
    old = written(old, f"old-{key}")
    old = F.broadcast(old) if old.count() <= SENT else old  # counted
    return at.select("_f", "_r", key, *cols).join(old, ["_f", "_r"], "left_anti").select(key, *cols)
