"""Changes of stored tables as frames: each function gives the table after the change.

The tables are plain Parquet, so a change is a join and a new version of what it touches; `replace_partitions` writes only
the partitions that the new rows have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_missing(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`state` and those of `rows` whose keys it lacks, with `created` (K1); of several new rows of one key the least by its
    other columns. A null key is a key."""
    rest = [c for c in state.columns if c not in keys]
    new = rows.select(*state.columns)
    if rest:
        one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*state.columns)
    else:
        one = new.distinct()
    same = None
    for k in keys:
        hit = one[k].eqNullSafe(state[k])
        same = hit if same is None else same & hit
    fresh = one.join(state, same, "left_anti")
    return state.withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True)))


def update_where(state: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    """`state` with new values where the test holds (K4, K19); a test that is null changes nothing."""
    return state.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(state: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """`state` without the rows whose keys are in `doomed` (K5)."""
    return state.join(doomed.select(*keys), keys, "left_anti").select(*state.columns)


def replace_documents(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of the documents in `rows` replaced by those in `rows` (K6)."""
    return state.join(rows.select(key).distinct(), key, "left_anti").select(*state.columns).unionByName(rows.select(*state.columns))


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """`rows` written so that only the partitions of `by` that they have are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def reopen_memberships(state: DataFrame, winners: DataFrame) -> DataFrame:
    """Memberships after an election (K17). `state`: id, politician_id, riding_id, party_id, start_date, end_date; `winners`:
    politician_id, riding_id, party_id, date. A membership of a winner for the same riding and party that is open or ended on
    the day goes on; a winner without one gets a new row, its id beyond the greatest by the order of the keys."""
    keys = ["politician_id", "riding_id", "party_id"]
    won = winners.groupBy(*keys).agg(F.max("date").alias("_on"))
    goes_on = F.col("_on").isNotNull() & (F.col("end_date").isNull() | (F.col("end_date") == F.col("_on")))
    joined = state.join(won, keys, "left").withColumn("_goes", goes_on)
    kept = joined.withColumn("end_date", F.when(F.col("_goes"), F.lit(None)).otherwise(F.col("end_date"))).select(*state.columns)
    new = won.join(joined.filter("_goes").select(*keys), keys, "left_anti")
    # Ids are one per new row: the rows of one election, ordered by a window over them alone.
    top = state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    from pyspark.sql import Window

    made = new.crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.row_number().over(Window.orderBy(*keys)))  # one row
    none = F.lit(None)
    row = {"start_date": F.col("_on"), "end_date": none.cast("date")}
    return kept.unionByName(made.select(*[(row[c].alias(c) if c in row else F.col(c) if c in ("id", *keys) else none.cast(dict(state.dtypes)[c]).alias(c)) for c in state.columns]))


def with_placeholders(state: DataFrame, referenced: DataFrame, key: str, stub: dict[str, Column]) -> DataFrame:
    """`state` with a stub row for each referenced key that it lacks."""
    new = referenced.filter(F.col(key).isNotNull()).select(key).distinct().join(state.select(key), key, "left_anti")
    kinds = dict(state.dtypes)
    return state.unionByName(new.select(*[F.col(c) if c == key else stub.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in state.columns]))


def archived(state: DataFrame, new: DataFrame, key: str, suffix: Column) -> DataFrame:
    """Versions after a replacement (G11): where `new` has the key, what was public is kept under the key and a suffix, not
    public; the new row is public under the key itself."""
    hit = state.join(new.select(key).distinct(), key, "left_semi").withColumn(key, F.concat_ws("-", F.col(key), suffix)).withColumn("public", F.lit(False))
    rest = state.join(new.select(key).distinct(), key, "left_anti")
    return rest.select(*state.columns).unionByName(hit.select(*state.columns)).unionByName(new.withColumn("public", F.lit(True)).select(*state.columns))


def outgoing(items: DataFrame, subscribers: DataFrame, topic: str, subject: Column, line: Column, order: Column) -> DataFrame:
    """Messages to send (K11): one per topic with items and active subscriber, the items' lines in order. The lines are those
    of one run of a topic, at most its limit of items."""
    body = items.groupBy(topic).agg(subject.alias("subject"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return body.join(subscribers, topic).select("user", topic, F.left("subject", F.lit(200)).alias("subject"), "body")
