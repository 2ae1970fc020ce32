"""Attributes as known at event time, by dyadic time nodes (problem 4).

A record of an entity's attribute is *known* on a day when both its start and the day it was recorded aren't later. Of
the known records the one with the latest start holds; of equal ones the one recorded last (then the greatest id).
`holding_periods` turns the log into disjoint half-open day intervals, one per record that ever holds. An interval is cut
into its maximal dyadic nodes (level, day >> level), at most two per level; an event looks up the nodes that enclose its
day, one per level. So a range condition becomes an equi-join whose keys spread even a single hot entity
over many partitions, and no pair of an event with a record that doesn't hold is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days are counted from 1600-01-01; the domain has 2**LEVELS days (717 years), open intervals end with it.
LEVELS = 18
_ORIGIN = "1600-01-01"


def day_number(d: Column) -> Column:
    return F.datediff(d, F.lit(_ORIGIN).cast("date"))


def holding_periods(log: DataFrame, entity: str, start: str, recorded: str, tie: str) -> DataFrame:
    """`log` with `_from`, `_to` (day numbers, half-open): the days on which the row is the one that holds.

    Rows that never hold, or lack an entity, start or recording time, are left out. Repeated rows (equal in `tie`) count
    once. A log of one entity is its corrections and memberships, so the window per entity stays small."""
    known = F.greatest(day_number(F.col(start)), day_number(F.to_date(F.col(recorded))))
    rows = (
        log.filter(F.col(entity).isNotNull() & F.col(start).isNotNull() & F.col(recorded).isNotNull())
        .dropDuplicates([tie])
        .withColumn("_from", F.greatest(known, F.lit(0)))
    )
    stronger = (
        Window.partitionBy(entity)
        .orderBy(F.desc(start), F.desc(recorded), F.desc(tie))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    to = F.coalesce(F.min("_from").over(stronger), F.lit(1 << LEVELS))
    return rows.withColumn("_to", to).filter("_from < _to")


def dyadic_nodes(lo: Column, hi: Column, levels: int = LEVELS) -> Column:
    """Array of struct(level, node): the maximal dyadic nodes that tile [lo, hi).

    At each level the cut has at most one node on its left edge and one on its right: with a = ceil(lo / 2^k) and
    b = floor(hi / 2^k), the left node is a if a is odd, the right one b - 1 if b is odd, while a < b."""
    parts = []
    for k in range(levels + 1):
        a = F.shiftright(lo + F.lit((1 << k) - 1), k)
        b = F.shiftright(hi, k)
        node = lambda x, k=k: F.struct(F.lit(k).alias("level"), x.cast("int").alias("node"))
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        parts += [F.when((a < b) & odd(a), node(a)), F.when((a < b) & odd(b), node(b - 1))]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def as_known(
    events: DataFrame, log: DataFrame, *, entity: str, at: str, start: str, recorded: str, tie: str, attributes: list[str]
) -> DataFrame:
    """`events` (columns `entity`, `at` date and any others) with the log's `attributes` that were known to hold then.

    Attributes come under their own names (a clashing event column keeps its name and the attribute gets the prefix
    `known_`); they are null where nothing was known or the event lacks entity or day. Every event comes out once; no
    event is dropped. Events are first reduced to distinct (entity, day), so a busy day costs one lookup."""
    held = holding_periods(log, entity, start, recorded, tie)
    names = {a: f"known_{a}" if a in events.columns else a for a in attributes}
    nodes = held.select(
        F.col(entity).alias("_e"), F.explode(dyadic_nodes(F.col("_from"), F.col("_to"))).alias("_n"), "_from", "_to",
        *[F.col(a).alias(n) for a, n in names.items()],
    ).select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")
    asked = events.select(F.col(entity).alias("_e"), day_number(F.col(at)).alias("_d")).dropna().distinct()
    keys = asked.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn(
        "_node", F.expr("shiftright(_d, _level)")
    )
    found = (
        keys.join(nodes, ["_e", "_level", "_node"])
        .filter("_from <= _d and _d < _to")
        .select(F.col("_e").alias("_fe"), F.col("_d").alias("_fd"), *names.values())
    )
    on = (F.col(entity) == F.col("_fe")) & (day_number(F.col(at)) == F.col("_fd"))
    return events.join(found, on, "left").drop("_fe", "_fd")


def latest_known(log: DataFrame, entity: str, start: str, recorded: str, tie: str, attribute: str) -> DataFrame:
    """entity, attribute: of the row with the latest start, then recorded last, in the whole log (nulls as above)."""
    rank = F.struct(F.col(start), F.col(recorded), F.col(tie))
    usable = log.filter(F.col(entity).isNotNull() & F.col(start).isNotNull() & F.col(recorded).isNotNull())
    return usable.groupBy(entity).agg(F.max_by(attribute, rank).alias(attribute))
