"""Further operators of the survey as queries: views, set-based projections, presentation groupings, scalars, upserts."""

from __future__ import annotations


from pyspark.sql import functions as F

from quorumlake.catalog import once, table
from quorumlake.functions import dates as dt
from quorumlake.functions import text as tx
from quorumlake.operators import filters as fl
from quorumlake.operators import language, ranking
from quorumlake.plans.debates import _UNI, SAID, _english, _said
from quorumlake.plans.records import BASE, ballots, members, people, questions, statements
from quorumlake.plans.registry import Registry
from quorumlake.streaming import jobs

REGISTRY = Registry()
query = REGISTRY.query


@query("s1_p17_scan", BASE + "SELECT id, name, slug FROM pol")
def scan(s, d):
    return people(s, d).select("id", "name", "slug")


@query("s3_views", "SELECT doc_id, doc_kind FROM documents WHERE doc_kind IN ('debate', 'evidence')")
def views(s, d):
    return table(s, d, "documents").filter(F.col("doc_kind").isin("debate", "evidence")).select("doc_id", "doc_kind")


@query("flt_p14_in_subquery", BASE + "SELECT id FROM mv WHERE votequestion_id IN (SELECT id FROM vq WHERE result = 'N') AND vote IN ('Y', 'P')")
def in_subquery(s, d):
    lost = questions(s, d).filter("result = 'N'").select(F.col("id").alias("votequestion_id"))
    return ballots(s, d).filter(F.col("vote").isin("Y", "P")).join(lost, "votequestion_id", "left_semi").select("id")


@query("flt_p25_admin_search", BASE + "SELECT id FROM pol WHERE lower(name) LIKE '%bar%' OR lower(slug) LIKE '%bar%'")
def admin_search(s, d):
    return people(s, d).filter(F.lower("name").contains("bar") | F.lower("slug").contains("bar")).select("id")


@query("flt_p26_analysed", BASE + "SELECT id FROM st WHERE NOT procedural AND politician_id IN (SELECT politician_id FROM em WHERE end_date IS NULL) AND time >= TIMESTAMP '2017-06-30 00:00:00' - INTERVAL 700 DAY")
def analysed(s, d):
    now = members(s, d).filter("end_date is null").select("politician_id")
    since = F.lit("2017-06-30").cast("timestamp_ntz") - F.expr("interval 700 days")
    return statements(s, d, "politician_id", "procedural", "time").filter(~F.col("procedural") & (F.col("time") >= since)).join(now, "politician_id", "left_semi").select("id")


@query("j4_bridge", BASE + ", br AS (SELECT DISTINCT politician_id, riding_id FROM em) SELECT st.id, br.riding_id FROM st JOIN br ON br.politician_id = st.politician_id")
def bridge(s, d):
    br = members(s, d).select("politician_id", "riding_id").distinct()
    return statements(s, d, "politician_id").join(br, "politician_id").select("id", "riding_id")


@query("j12_idempotent_ingest", BASE + "SELECT id FROM vq WHERE NOT EXISTS (SELECT 1 FROM pv WHERE pv.votequestion_id = vq.id AND pv.vote = 'F')")
def idempotent(s, d):
    have = once(table(s, d, "party_vote"), "id").filter("vote = 'F'").select(F.col("votequestion_id").alias("id"))
    return questions(s, d).join(have, "id", "left_anti").select("id")


@query("j15_w7_speakers_of_document", BASE + "SELECT document_id, politician_id, count(*) AS n FROM st WHERE politician_id IS NOT NULL GROUP BY document_id, politician_id")
def speakers_of(s, d):
    return statements(s, d, "document_id", "politician_id").filter("politician_id is not null").groupBy("document_id", "politician_id").agg(F.count("*").alias("n"))


@query("j18_ids_by_attribute", BASE + ", kv AS (SELECT DISTINCT who_hocid AS v, politician_id FROM st WHERE who_hocid IS NOT NULL AND politician_id IS NOT NULL) SELECT v, count(DISTINCT politician_id) AS candidates, min(politician_id) AS politician_id FROM kv GROUP BY v")
def ids_by_attribute(s, d):
    kv = statements(s, d, "who_hocid", "politician_id").filter("who_hocid is not null and politician_id is not null").select(F.col("who_hocid").alias("v"), "politician_id")
    return kv.groupBy("v").agg(F.countDistinct("politician_id").alias("candidates"), F.min("politician_id").alias("politician_id"))


@query("j23_merge_duplicates", BASE + ", keep AS (SELECT id, min(id) OVER (PARTITION BY name_family, name_given) AS kept FROM pol) SELECT mv.id, keep.kept AS politician_id FROM mv JOIN keep ON keep.id = mv.politician_id")
def merge_duplicates(s, d):
    """People of one full name become the first of them, wherever they are referred to."""
    p = people(s, d)
    first = p.groupBy("name_family", "name_given").agg(F.min("id").alias("kept"))
    keep = p.join(first, ["name_family", "name_given"]).select(F.col("id").alias("politician_id"), "kept")
    return ballots(s, d).join(keep, "politician_id").select("id", F.col("kept").alias("politician_id"))


@query("a4_exists", BASE + "SELECT session_id, count(*) > 0 AS has_votes, sum(CASE WHEN bill_id IS NULL THEN 1 ELSE 0 END) > 0 AS has_motions FROM vq GROUP BY session_id")
def exists(s, d):
    return questions(s, d).groupBy("session_id").agg((F.count("*") > 0).alias("has_votes"), (F.count_if(F.col("bill_id").isNull()) > 0).alias("has_motions"))


@query(
    "a13_item_counts",
    _UNI + """c AS (SELECT gram, count(*) AS cnt FROM g WHERE length(gram) > 2 AND gram NOT LIKE '%/%' GROUP BY gram), t AS (SELECT sum(cnt) AS n FROM c)
    SELECT gram, CAST(round_even(CAST(cnt AS DOUBLE) / (SELECT n FROM t) * 100000, 0) AS BIGINT) AS items FROM c WHERE cnt >= 5""",
)
def item_counts(s, d):
    """How often each word would stand in a hundred thousand."""
    return language.item_counts(language.frequencies(_english(s, d), [], "text", 1, min_count=5), 100_000).select("gram", "items")


@query("a34_year_range", BASE + ", r AS (SELECT min(year(date)) AS a, max(year(date)) AS b FROM vq) SELECT CAST(y AS INTEGER) AS y FROM (SELECT unnest(range(a, b + 1)) AS y FROM r)")
def year_range(s, d):
    r = questions(s, d).agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b"))
    return r.select(F.explode(F.sequence("b", "a", F.lit(-1))).alias("y"))


@query("a35_u5_distinct", BASE + "SELECT DISTINCT politician_id FROM st WHERE politician_id IS NOT NULL")
def distinct(s, d):
    return table(s, d, "statement").filter("politician_id is not null").select("politician_id").distinct()


@query("a38_complete_share", BASE + ", p AS (SELECT document_id, unnest(regexp_extract_all(content_fr, '<p[^>]*>')) AS p FROM st WHERE content_fr <> '') SELECT document_id, round(avg(CASE WHEN p LIKE '%data-HoCid%' THEN 1.0 ELSE 0.0 END), 9) AS share FROM p GROUP BY document_id")
def complete(s, d):
    p = statements(s, d, "document_id", "content_fr").filter("content_fr <> ''").select("document_id", F.explode(tx.paragraphs(F.col("content_fr"))).alias("p"))
    return p.groupBy("document_id").agg(F.round(F.avg(F.col("p.pid").isNotNull().cast("double")), 9).alias("share"))


@query("t1_sorted", BASE + "SELECT id, politician_id, start_date, row_number() OVER (PARTITION BY politician_id ORDER BY end_date DESC NULLS FIRST, start_date DESC, id) AS n FROM em")
def sorted_(s, d):
    return ranking.numbered(members(s, d), ["politician_id"], "n", F.desc_nulls_first("end_date"), F.desc("start_date"), F.col("id")).select("id", "politician_id", "start_date", "n")


@query("t10_first_or_none", BASE + "SELECT id FROM vq WHERE date <= DATE '2017-03-01' ORDER BY date DESC, id DESC LIMIT 1")
def first_or_none(s, d):
    return questions(s, d).filter(F.col("date") <= "2017-03-01").orderBy(F.desc("date"), F.desc("id")).limit(1).select("id")


@query("u8_disjoint", BASE + ", a AS (SELECT slug FROM pol), b AS (SELECT slug FROM party) SELECT (SELECT count(*) FROM a JOIN b ON a.slug = b.slug) = 0 AS disjoint")
def disjoint(s, d):
    return people(s, d).select("slug").join(table(s, d, "party").select("slug"), "slug", "left_semi").agg((F.count("*") == 0).alias("disjoint"))


@query("f30_letters_only", BASE + "SELECT id, regexp_replace(lower(who_en), '[^a-z]', '', 'g') AS letters FROM st")
def letters(s, d):
    return statements(s, d, "who_en").select("id", F.regexp_replace(F.lower("who_en"), "[^a-z]", "").alias("letters"))


@query("f35_equal_but_space", BASE + r"SELECT id, regexp_replace(content_en, '\s+', '', 'g') IS NOT DISTINCT FROM regexp_replace(content_fr, '\s+', '', 'g') AS same FROM st")
def equal(s, d):
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return statements(s, d, "content_en", "content_fr").select("id", bare("content_en").eqNullSafe(bare("content_fr")).alias("same"))


@query("d9_earliest", BASE + "SELECT id, least(start_date, end_date) AS first FROM em")
def earliest(s, d):
    return members(s, d).select("id", F.least("start_date", "end_date").alias("first"))


@query("m1_ratios", BASE + "SELECT id, CASE WHEN yea_total + nay_total = 0 THEN 0.0 ELSE CAST(least(yea_total, nay_total) AS DOUBLE) / (yea_total + nay_total) END AS share FROM vq")
def ratios(s, d):
    y, n = F.col("yea_total"), F.col("nay_total")
    return questions(s, d).select("id", F.coalesce(F.try_divide(F.least(y, n), y + n), F.lit(0.0)).alias("share"))


@query("r3_subheads", SAID + "SELECT document_id, h1_en, h2_en, min(sequence) AS first_seq FROM sd WHERE h2_en <> '' GROUP BY document_id, h1_en, h2_en")
def subheads(s, d):
    return _said(s, d, "h1_en", "h2_en").filter("h2_en <> ''").groupBy("document_id", "h1_en", "h2_en").agg(F.min("sequence").alias("first_seq"))


@query("n2_exploded_json", "SELECT event_id, key, value FROM (SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events) WHERE value IS NOT NULL")
def exploded(s, d):
    return table(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


@query("g6_fan_out", "SELECT s.user_id, count(*) AS messages FROM events e JOIN (SELECT DISTINCT user_id, event_type FROM events) s ON s.event_type = e.event_type GROUP BY s.user_id")
def fan_out(s, d):
    """Messages that each user gets: every event goes to all who have an event of its type. They are counted, not made, since
    messages grow with events x users: a topic is sent to its subscribers once, with the number of its events. The tables have
    no column for a subscription that ended or bounces."""
    e = table(s, d, "events")
    subs = e.select(F.col("event_type").alias("topic"), F.col("user_id").alias("user"), F.lit(True).alias("active"), F.lit(False).alias("bouncing")).distinct()
    sent = jobs.fan_out(e.groupBy(F.col("event_type").alias("topic")).agg(F.count("*").alias("events")), subs)
    return sent.groupBy(F.col("user").alias("user_id")).agg(F.sum("events").alias("messages"))



QUERIES, ORACLE = REGISTRY.queries, REGISTRY.sql
