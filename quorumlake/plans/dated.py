"""Queries of the problems tagged general: p4 (attributes at event time) and p6 (history of attributes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.catalog import once, table
from quorumlake.operators.asof import as_known, latest_known
from quorumlake.operators.history import versions

_LOG = {"entity": "politician_id", "start": "start_date", "recorded": "recorded_at", "tie": "id"}


def _votes(spark: SparkSession, folder: str) -> DataFrame:
    votes = once(table(spark, folder, "member_vote").select("id", "votequestion_id", "politician_id", "vote"), "id")
    asked = once(table(spark, folder, "vote_question").select(F.col("id").alias("votequestion_id"), "date"), "votequestion_id")
    return votes.join(asked, "votequestion_id", "left")


def p4_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Every member_vote with the party known then (0 if none) and that party's party_vote on the question, if any."""
    log = once(table(spark, folder, "elected_member"), "id")
    known = as_known(_votes(spark, folder), log, at="date", attributes=["party_id"], **_LOG)
    known = known.withColumn("party_id", F.coalesce("party_id", F.lit(0).cast("bigint")))
    lines = once(table(spark, folder, "party_vote").drop("id"), ["votequestion_id", "party_id"]).select(
        "votequestion_id", "party_id", F.col("vote").alias("party_vote"), F.col("disagreement").alias("party_disagreement")
    )
    return known.join(lines, ["votequestion_id", "party_id"], "left").select(
        F.col("id").alias("member_vote_id"), "votequestion_id", "politician_id", "vote", "party_id", "party_vote",
        "party_disagreement",
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Votes whose party as known then differs from the politician's latest party in the whole log."""
    log = once(table(spark, folder, "elected_member"), "id")
    known = as_known(_votes(spark, folder), log, at="date", attributes=["party_id"], **_LOG)
    now = latest_known(log, attribute="party_id", **_LOG).withColumnRenamed("party_id", "_now")
    return (
        known.join(now, "politician_id", "left")
        .select(
            F.col("id").alias("member_vote_id"),
            F.coalesce("party_id", F.lit(0)).cast("bigint").alias("party_id"),
            F.coalesce("_now", F.lit(0)).alias("_now"),
        )
        .filter("party_id <> _now")
        .select("member_vote_id", "party_id")
    )


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return versions(
        table(spark, folder, "member_snapshot"), entity="politician_id", taken="taken_on", loaded="loaded_at",
        attributes=["party_id", "riding_id", "start_date", "end_date"],
    )


def p6_history(spark: SparkSession, folder: str) -> DataFrame:
    """All versions with every attribute and their period."""
    return _versions(spark, folder)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c)
    return _versions(spark, folder).select("politician_id", "party_id", text("valid_from"), text("valid_to"))


QUERIES = {"p4_attributes": p4_attributes, "p4_found": p4_found, "p6_history": p6_history, "p6_found": p6_found}

_KNOWN = """
WITH log AS (SELECT DISTINCT id, politician_id, party_id, start_date, recorded_at FROM elected_member
             WHERE politician_id IS NOT NULL AND start_date IS NOT NULL AND recorded_at IS NOT NULL),
mv AS (SELECT DISTINCT id, votequestion_id, politician_id, vote FROM member_vote),
vq AS (SELECT DISTINCT id, date FROM vote_question),
votes AS (SELECT mv.*, vq.date FROM mv LEFT JOIN vq ON vq.id = mv.votequestion_id),
ranked AS (SELECT v.id, l.party_id, row_number() OVER (PARTITION BY v.id ORDER BY l.start_date DESC, l.recorded_at DESC,
             l.id DESC) AS rn
           FROM votes v JOIN log l ON l.politician_id = v.politician_id AND l.start_date <= v.date
             AND CAST(l.recorded_at AS DATE) <= v.date),
known AS (SELECT v.*, COALESCE(r.party_id, 0) AS party_id FROM votes v LEFT JOIN ranked r ON r.id = v.id AND r.rn = 1)
"""
_ISLANDS = """
WITH picked AS (SELECT *, row_number() OVER (PARTITION BY politician_id, taken_on ORDER BY loaded_at DESC,
                  party_id DESC NULLS LAST, riding_id DESC NULLS LAST, start_date DESC NULLS LAST,
                  end_date DESC NULLS LAST) AS rn FROM member_snapshot
                WHERE politician_id IS NOT NULL AND taken_on IS NOT NULL),
cal AS (SELECT taken_on, row_number() OVER (ORDER BY taken_on) AS no, lead(taken_on) OVER (ORDER BY taken_on) AS nxt
        FROM (SELECT DISTINCT taken_on FROM member_snapshot WHERE politician_id IS NOT NULL AND taken_on IS NOT NULL)),
runs AS (SELECT p.politician_id, p.party_id, p.riding_id, p.start_date, p.end_date, c.taken_on, c.nxt, c.no,
           c.no - row_number() OVER (PARTITION BY p.politician_id, p.party_id, p.riding_id, p.start_date, p.end_date
                                     ORDER BY c.no) AS grp
         FROM picked p JOIN cal c ON c.taken_on = p.taken_on WHERE p.rn = 1),
vers AS (SELECT politician_id, party_id, riding_id, start_date, end_date, min(taken_on) AS valid_from,
           max(no) AS last_no FROM runs GROUP BY politician_id, party_id, riding_id, start_date, end_date, grp)
"""
ORACLE = {
    "p4_attributes": _KNOWN
    + """, pv AS (SELECT DISTINCT votequestion_id, party_id, vote, disagreement FROM party_vote)
    SELECT k.id AS member_vote_id, k.votequestion_id, k.politician_id, k.vote, k.party_id, pv.vote AS party_vote,
      pv.disagreement AS party_disagreement
    FROM known k LEFT JOIN pv ON pv.votequestion_id = k.votequestion_id AND pv.party_id = k.party_id""",
    "p4_found": _KNOWN
    + """, latest AS (SELECT politician_id, party_id FROM (SELECT *, row_number() OVER (PARTITION BY politician_id
      ORDER BY start_date DESC, recorded_at DESC, id DESC) AS rn FROM log) WHERE rn = 1)
    SELECT k.id AS member_vote_id, k.party_id FROM known k LEFT JOIN latest l ON l.politician_id = k.politician_id
    WHERE k.party_id <> COALESCE(l.party_id, 0)""",
    "p6_history": _ISLANDS
    + """SELECT v.politician_id, v.party_id, v.riding_id, v.start_date, v.end_date, v.valid_from, c.nxt AS valid_to
    FROM vers v JOIN cal c ON c.no = v.last_no""",
    "p6_found": _ISLANDS
    + """SELECT v.politician_id, v.party_id, CAST(v.valid_from AS VARCHAR) AS valid_from,
      COALESCE(CAST(c.nxt AS VARCHAR), '') AS valid_to FROM vers v JOIN cal c ON c.no = v.last_no""",
}
