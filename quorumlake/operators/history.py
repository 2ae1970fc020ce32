"""Versions of changing attributes from raw periodic snapshots, by gaps and islands (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versions(snapshots: DataFrame, *, entity: str, taken: str, loaded: str, attributes: list[str]) -> DataFrame:
    """entity, attributes, valid_from, valid_to (dates; valid_to null while the version still holds).

    Of several loads of one entity and date the latest counts; rows equal in `loaded` but different in the attributes
    are decided by the greatest attribute values (nulls last), so the result is the same on every run. A version is a
    longest run of consecutive snapshot dates, over all dates on which any snapshot was taken, with the same attributes;
    null equals null. Its end is the next date after the run. Rows without entity or date are left out.

    The loads are reduced by a partial aggregate before the shuffle; after it an entity has at most one row per snapshot
    date, which bounds the window. The calendar of snapshot dates is one row per date and is numbered by a window of its
    own; it has the size of a calendar, never of the data."""
    rows = snapshots.filter(F.col(entity).isNotNull() & F.col(taken).isNotNull())
    # The fields start with a "present" flag, as a null sorts below a value in a struct.
    pick = F.struct(F.col(loaded), *[F.struct(F.col(a).isNotNull(), F.col(a)).alias(f"_{i}") for i, a in enumerate(attributes)])
    kept = rows.groupBy(F.col(entity).alias("_e"), F.col(taken).alias("_t")).agg(F.max(pick).alias("_k"))
    kept = kept.select("_e", "_t", *[F.col(f"_k._{i}.{a}").alias(a) for i, a in enumerate(attributes)])

    calendar = rows.select(F.col(taken).alias("_t")).distinct()
    by_date = Window.partitionBy(F.lit(1)).orderBy("_t")
    calendar = calendar.select("_t", F.row_number().over(by_date).alias("_no"), F.lead("_t").over(by_date).alias("_next"))
    # A calendar of a thousand years of days has some 12 MB; on it alone a broadcast is safe.
    dated = kept.join(F.broadcast(calendar), "_t")

    own = Window.partitionBy("_e").orderBy("_no")
    state = F.struct(*[F.col(a) for a in attributes])
    mark = F.xxhash64(F.to_json(state, {"ignoreNullFields": "false"}))
    changed = dated.withColumn("_mark", mark).withColumn(
        "_new",
        (
            F.lag("_no").over(own).isNull()
            | (F.lag("_no").over(own) != F.col("_no") - 1)
            | (F.lag("_mark").over(own) != F.col("_mark"))
            | ~F.lag(state).over(own).eqNullSafe(state)
        ).cast("int"),
    )
    islands = changed.withColumn("_island", F.sum("_new").over(own))
    return (
        islands.groupBy("_e", "_island")
        .agg(
            *[F.first(a).alias(a) for a in attributes],
            F.min("_t").alias("valid_from"),
            F.max_by("_next", "_no").alias("valid_to"),
        )
        .select(F.col("_e").alias(entity), *attributes, "valid_from", "valid_to")
    )
