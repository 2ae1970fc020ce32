"""Streaming jobs run over the tables once, with SQL of the same meaning (ids G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.catalog import table
from quorumlake.plans.registry import Registry
from quorumlake.streaming import jobs

REGISTRY = Registry()
query = REGISTRY.query
_HALF = 5000


@query(
    "g1_g2_queue",
    f"""WITH st AS (SELECT user_id, max(event_id) AS doc FROM events WHERE event_id <= {_HALF} GROUP BY user_id),
    ch AS (SELECT user_id, event_id AS doc, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'delete' ELSE 'update' END AS action FROM events WHERE event_id > {_HALF}),
    up AS (SELECT user_id, max(doc) AS doc FROM ch WHERE action = 'update' GROUP BY user_id)
    SELECT u.user_id, u.doc FROM (SELECT COALESCE(up.user_id, st.user_id) AS user_id, COALESCE(up.doc, st.doc) AS doc FROM st FULL JOIN up ON up.user_id = st.user_id) u
    WHERE u.user_id NOT IN (SELECT user_id FROM ch WHERE action = 'delete')""",
)
def queue(s, d):
    """The first events as the index, the rest as its change queue."""
    start = table(s, d, "events").filter(F.col("event_id") <= _HALF).groupBy("user_id").agg(F.max("event_id").alias("doc"))
    consumer = jobs.QueueConsumer(start, "user_id", "doc")
    action = F.when((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0), "delete").otherwise("update")
    changes = jobs.file_stream(s, d, "events").filter(F.col("event_id") > _HALF).select("user_id", F.col("event_id").alias("doc"), action.alias("action"))
    jobs.run_once(changes, consumer)
    return consumer.table()


@query(
    "g3_g4_alerts",
    """SELECT DISTINCT e.event_type AS topic, e.user_id FROM events e JOIN (SELECT 'purchase' AS t UNION ALL SELECT 'signup') x ON x.t = e.event_type""",
)
def alerts(s, d):
    topics = s.createDataFrame([("purchase",), ("signup",)], "topic string")
    items = jobs.file_stream(s, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    hits = jobs.alerts(items, topics, F.col("event_type") == F.col("topic"), "user_id", "at", watermark="90 days")
    return jobs.drained(hits.select("topic", "user_id"))


@query("g7_g15_once", "SELECT user_id, event_type FROM events GROUP BY user_id, event_type")
def once(s, d):
    return jobs.drained(jobs.file_stream(s, d, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


@query("g_window_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY date_trunc('day', ts), event_type")
def windows(s, d):
    events = jobs.file_stream(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    got = jobs.drained(jobs.window_counts(events, "at", ["event_type"], "1 day", "1 hour"), "complete")
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("g12_latest", "SELECT user_id, max(ts) AS latest FROM events GROUP BY user_id")
def latest(s, d):
    got = jobs.file_stream(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("latest"))
    return jobs.drained(got, "complete")


QUERIES, ORACLE = REGISTRY.queries, REGISTRY.sql
