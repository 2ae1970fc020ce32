"""Ordered scans: carry-forward, run numbers, consecutive groups.

Each scan works in two levels, so that a group that holds a third of all rows is not scanned by one task: rows are scanned
inside (group, chunk), the chunks' summaries, one row per chunk, are scanned inside the group, and the two are put
together. `chunk` is any column that doesn't decrease along the order (a time bucket, a sequence number divided by 1000).
Without a chunk a plain window over the group is used, which suits groups of proven small size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def fill_forward(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, chunk: str | None = None) -> DataFrame:
    """`out`: the last non-null `value` up to and with the row, in the order of `order` within `keys`; null before any."""
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct(*_cols(order))
    ends = df.filter(F.col(value).isNotNull()).groupBy(*keys, chunk).agg(F.max_by(value, rank).alias("_end"))
    allc = df.select(*keys, chunk).distinct().join(ends, [*keys, chunk], "left")
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = allc.select(*keys, chunk, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    got = df.withColumn("_own", F.last(value, ignorenulls=True).over(inner)).join(carried, [*keys, chunk], "left")
    return got.withColumn(out, F.coalesce("_own", "_carried")).drop("_own", "_carried")


def run_numbers(
    df: DataFrame, keys: list[str], order: list[str], value: str | list[str], out: str, chunk: str | None = None, same: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """`out`: number from 1 of the run that the row is in, within `keys`: a run goes on while `value` is equal (null equals
    null), or while `same` of the row before and the row, structs of the columns of `value`, is true.

    Rows equal in `order` are put in an unspecified order, so `order` should be unique within `keys`."""
    names = [value] if isinstance(value, str) else value
    boxed = F.struct(*[F.col(n).alias(n) for n in names])
    goes_on = lambda prev, cur: prev.isNotNull() & F.coalesce(same(prev, cur) if same else prev.eqNullSafe(cur), F.lit(False))
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_new", (~goes_on(F.lag(boxed).over(w), boxed)).cast("long")).withColumn(out, F.sum("_new").over(w)).drop("_new")
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    prev = F.lag(boxed).over(inner)
    # The first row of a chunk counts as no change here; the chunk's offset decides on it.
    inside = df.withColumn("_new", F.when(prev.isNull(), F.lit(0)).otherwise((~goes_on(prev, boxed)).cast("long")))
    rank = F.struct(*_cols(order))
    per = inside.groupBy(*keys, chunk).agg(
        F.sum("_new").alias("_n"), F.min_by(boxed, rank).alias("_first"), F.max_by(boxed, rank).alias("_last")
    )
    along = Window.partitionBy(*keys).orderBy(chunk)
    per = per.withColumn("_start", (~goes_on(F.lag("_last").over(along), F.col("_first"))).cast("long"))
    upto = F.sum(F.col("_start") + F.col("_n")).over(along) - F.col("_n")
    per = per.select(*keys, chunk, upto.alias("_offset"))
    got = inside.withColumn("_in", F.sum("_new").over(inner)).join(per, [*keys, chunk])
    return got.withColumn(out, F.col("_offset") + F.col("_in")).drop("_new", "_in", "_offset")


def ordinals(df: DataFrame, keys: list[str], order: list[str], out: str, chunk: str) -> DataFrame:
    """`out`: place of the row from 1 within `keys`: its place in the chunk and the rows of the chunks before, so no group is
    sorted by one task. Null keys are groups too."""
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    along = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*keys, chunk).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    renamed = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, chunk])], "_before")
    on = None
    for i, k in enumerate([*keys, chunk]):
        hit = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = hit if on is None else on & hit
    placed = df.withColumn("_in", F.row_number().over(inner)).join(renamed, on)
    return placed.withColumn(out, F.col("_before") + F.col("_in")).select(*df.columns, out)


def fill_all(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], chunk: str) -> DataFrame:
    """`fill_forward` of several columns at once, value -> out (W13): one scan of the rows and one of the chunks' last values."""
    inner = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct(*_cols(order))
    ends = df.groupBy(*keys, chunk).agg(*[F.max(F.when(F.col(v).isNotNull(), F.struct(rank.alias("r"), F.col(v).alias("v"))))["v"].alias(f"_e_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, chunk, *[F.last(f"_e_{v}", ignorenulls=True).over(before).alias(f"_c_{v}") for v in values])
    got = df.withColumns({f"_o_{v}": F.last(v, ignorenulls=True).over(inner) for v in values}).join(carried, [*keys, chunk], "left")
    return got.withColumns({out: F.coalesce(f"_o_{v}", f"_c_{v}") for v, out in values.items()}).drop(*[f"_{k}_{v}" for v in values for k in "oc"])
