"""Queries over people, memberships, ballots and list resources (ids P, J, A1-A11, A37, A39, W1-W3, T, U of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.catalog import current_rows, once, table
from quorumlake.operators import filters as fl
from quorumlake.operators import joins, ranking, votes
from quorumlake.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

# Repeated rows count once. The SQL names the same relations.
BASE = """WITH em AS (SELECT DISTINCT * FROM elected_member), pol AS (SELECT DISTINCT * FROM politician),
vq AS (SELECT DISTINCT * FROM vote_question),
mv AS (SELECT DISTINCT id, votequestion_id, member_id, politician_id, vote, dissent FROM member_vote),
pv AS (SELECT DISTINCT * FROM party_vote),
st AS (SELECT DISTINCT id, document_id, time, source_id, slug, h1_en, h2_en, member_id, politician_id, who_en, who_hocid,
  who_context_en, content_en, content_fr, sequence, wordcount, procedural, statement_type, feed FROM statement) """


def members(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "elected_member"), "id")


def people(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "politician"), "id")


def questions(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "vote_question"), "id")


def ballots(s: SparkSession, d: str) -> DataFrame:
    return once(table(s, d, "member_vote").drop("recorded_at"), "id")


def statements(s: SparkSession, d: str, *cols: str) -> DataFrame:
    """Statements once by id; only `cols` are read. Where texts are among them they aren't shuffled."""
    if any(c.startswith("content_") for c in cols):
        return current_rows(table(s, d, "statement"), "id", "imported_at", *cols)
    return once(table(s, d, "statement").select("id", "imported_at", *cols), "id", F.col("imported_at")).drop("imported_at")


def _ballots_with_party(s: SparkSession, d: str) -> DataFrame:
    held = members(s, d).select(F.col("id").alias("member_id"), "party_id")
    return ballots(s, d).join(held, "member_id").select("id", F.col("votequestion_id").alias("vote_id"), "party_id", F.col("vote").alias("ballot"))


INDEPENDENT = 7


def _independent(s: SparkSession, d: str) -> DataFrame:
    """party_id of the independents, one row."""
    return table(s, d, "party").filter("short_name_en = 'Independent'").agg(F.coalesce(F.min("id"), F.lit(INDEPENDENT).cast("long")).alias("party_id"))


_LINES = (
    BASE
    + """, b AS (SELECT mv.id, mv.votequestion_id AS vote_id, em.party_id, mv.vote AS ballot FROM mv JOIN em ON em.id = mv.member_id
  WHERE em.party_id IS NOT NULL AND mv.votequestion_id IS NOT NULL),
ind AS (SELECT min(id) AS id FROM party WHERE short_name_en = 'Independent'),
c AS (SELECT vote_id, party_id, ballot, count(*) AS n FROM b WHERE party_id <> (SELECT COALESCE(id, 7) FROM ind)
  GROUP BY vote_id, party_id, ballot),
r AS (SELECT *, row_number() OVER (PARTITION BY vote_id, party_id ORDER BY n DESC,
  CASE ballot WHEN 'Y' THEN 0 WHEN 'N' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) AS rn FROM c),
yn AS (SELECT vote_id, party_id, sum(CASE WHEN ballot = 'Y' THEN n ELSE 0 END) AS y,
  sum(CASE WHEN ballot = 'N' THEN n ELSE 0 END) AS n FROM c GROUP BY vote_id, party_id),
lines AS (SELECT r.vote_id, r.party_id,
  CASE WHEN yn.y + yn.n > 0 AND least(yn.y, yn.n) * 1.0 / (yn.y + yn.n) >= 0.15 THEN 'F' ELSE r.ballot END AS vote,
  CASE WHEN yn.y + yn.n > 0 THEN CAST(least(yn.y, yn.n) AS DOUBLE) / (yn.y + yn.n) ELSE 0.0 END AS disagreement
  FROM r JOIN yn ON yn.vote_id = r.vote_id AND yn.party_id = r.party_id WHERE r.rn = 1) """
)


@query("a6_a7_party_lines", _LINES + "SELECT vote_id, party_id, vote, disagreement FROM lines")
def party_lines(s, d):
    return votes.party_lines(_ballots_with_party(s, d), _independent(s, d))


@query(
    "a8_dissents",
    _LINES
    + """SELECT b.id, b.vote_id, b.party_id, b.ballot, COALESCE(b.ballot IN ('Y','N') AND l.vote IN ('Y','N') AND b.ballot <> l.vote,
    false) AS dissent FROM b LEFT JOIN lines l ON l.vote_id = b.vote_id AND l.party_id = b.party_id""",
)
def dissent_flags(s, d):
    cast = _ballots_with_party(s, d).filter("party_id is not null and vote_id is not null")
    return votes.dissents(cast, votes.party_lines(cast, _independent(s, d)))


@query(
    "a9_u7_absent",
    BASE
    + """, due AS (SELECT DISTINCT vq.id AS vote_id, em.politician_id FROM vq JOIN em ON em.start_date <= vq.date
    AND (em.end_date IS NULL OR em.end_date >= vq.date)),
    cast_ AS (SELECT DISTINCT votequestion_id AS vote_id, politician_id, vote FROM mv)
    SELECT vote_id, politician_id, vote FROM cast_ UNION ALL
    SELECT due.vote_id, due.politician_id, 'A' AS vote FROM due WHERE NOT EXISTS (SELECT 1 FROM cast_ c
      WHERE c.vote_id = due.vote_id AND c.politician_id = due.politician_id)""",
)
def absent(s, d):
    """Ballots, and an absence for everyone in office on the day who cast none.

    Absences grow with questions x members, so no join or shuffle holds them: who is in office is found once a day, what each
    has voted on that day is set beside it, and the day's other questions are unfolded last."""
    q = questions(s, d).select(F.col("id").alias("vote_id"), "date")
    cast = ballots(s, d).select(F.col("votequestion_id").alias("vote_id"), "politician_id", "vote").distinct()
    asked = q.groupBy("date").agg(F.collect_list(F.struct("vote_id")).alias("asked"))  # the questions of one day
    voted = cast.join(q, "vote_id").groupBy("date", "politician_id").agg(F.collect_set(F.struct("vote_id")).alias("voted"))
    held = joins.merged(members(s, d).select("politician_id", "start_date", "end_date"), "politician_id", "start_date", "end_date")
    due = joins.in_range(asked.select("date"), held, "date", "start_date", "end_date", bucket_days=31).select("date", "politician_id")
    left = due.join(voted, ["date", "politician_id"], "left").join(asked, "date")
    left = left.select("politician_id", F.explode(F.when(F.col("voted").isNull(), F.col("asked")).otherwise(F.array_except("asked", "voted"))).alias("q"))
    return cast.unionByName(left.select("q.vote_id", "politician_id", F.lit("A").alias("vote")))


@query(
    "a37_sides",
    BASE
    + """, p AS (SELECT pv.votequestion_id, party.slug, pv.vote FROM pv JOIN party ON party.id = pv.party_id)
    SELECT votequestion_id, string_agg(CASE WHEN vote = 'Y' THEN slug END, ',' ORDER BY slug) AS yeas,
      string_agg(CASE WHEN vote = 'N' THEN slug END, ',' ORDER BY slug) AS nays FROM p GROUP BY votequestion_id""",
)
def sides(s, d):
    named = once(table(s, d, "party_vote"), "id").join(F.broadcast(table(s, d, "party").select(F.col("id").alias("party_id"), "slug")), "party_id")
    of = lambda v: F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(F.col("vote") == v, F.col("slug")))), ","), F.lit(""))
    return named.groupBy("votequestion_id").agg(of("Y").alias("yeas"), of("N").alias("nays"))


@query(
    "a39_totals",
    BASE
    + """, c AS (SELECT votequestion_id, sum(CASE WHEN vote='Y' THEN 1 ELSE 0 END) AS cy, sum(CASE WHEN vote='N' THEN 1 ELSE 0 END) AS cn
    FROM mv GROUP BY votequestion_id)
    SELECT vq.id AS vote_id, vq.yea_total, vq.nay_total, CAST(COALESCE(c.cy,0) AS BIGINT) AS counted_y, CAST(COALESCE(c.cn,0) AS BIGINT) AS counted_n,
    (vq.yea_total + vq.nay_total) < 100 AS small, (vq.yea_total <> COALESCE(c.cy,0) OR vq.nay_total <> COALESCE(c.cn,0)) AS differs
    FROM vq LEFT JOIN c ON c.votequestion_id = vq.id""",
)
def totals(s, d):
    q = questions(s, d).withColumnRenamed("id", "vote_id")
    return votes.totals_check(q, ballots(s, d).select(F.col("votequestion_id").alias("vote_id"), F.col("vote").alias("ballot")))


@query(
    "flt_p2_p5_votes",
    BASE + "SELECT id, session_id, number, date, result FROM vq WHERE bill_id IS NULL AND date >= DATE '2016-06-01' AND nay_total < 40 AND session_id = '41-1'",
)
def vote_list(s, d):
    q = questions(s, d)
    sess = "41-1"
    r = fl.Resource(
        q, {"bill": fl.ByColumn("bill_id", ("exact", "isnull")), "date": fl.ByColumn("date", fl.NUMBERS), "nay_total": fl.ByColumn("nay_total", fl.NUMBERS),
            "session": fl.ByColumn("session_id")}, (F.desc("date"), F.desc("number")),
    )
    got = r.query([("bill__isnull", "true"), ("date__gte", "2016-06-01"), ("nay_total__lt", "40"), ("session", "x"), ("session", sess), ("date__lt", "")])
    return got.select("id", "session_id", "number", "date", "result")


@query(
    "flt_p6_p8_people",
    BASE + "SELECT id, name FROM pol WHERE lower(name) LIKE '%an%' AND name_family LIKE 'B%' AND gender = 'F'",
)
def people_list(s, d):
    r = fl.Resource(people(s, d), {"name": fl.ByColumn("name", fl.STRINGS), "family": fl.ByColumn("name_family", fl.STRINGS), "gender": fl.ByColumn("gender")}, (F.col("id"),))
    return r.query({"name__icontains": "AN", "family__startswith": "B", "gender": "F"}).select("id", "name")


@query("flt_p8_speeches", BASE + "SELECT id, document_id, sequence FROM st WHERE politician_id = 21 AND NOT procedural UNION ALL SELECT id, document_id, sequence FROM st WHERE politician_id IN (SELECT id FROM pol WHERE slug = 'jerome-kellkorerby-11') AND procedural")
def speeches(s, d):
    """One person by number, one by the end of an address."""
    st = statements(s, d, "document_id", "sequence", "politician_id", "procedural")
    r = fl.Resource(st, {"politician": fl.ByPerson("politician_id", people(s, d)), "procedural": fl.ByColumn("procedural")}, (F.col("document_id"), F.col("sequence")))
    one = r.query({"politician": "21", "procedural": "false"}).select("id", "document_id", "sequence")
    return one.unionByName(r.query({"politician": "/politicians/jerome-kellkorerby-11/", "procedural": "True"}).select("id", "document_id", "sequence"))


@query("t2_page", BASE + "SELECT id, date, number FROM vq ORDER BY date DESC, number DESC, id LIMIT 21 OFFSET 5")
def page(s, d):
    r = fl.Resource(questions(s, d).select("id", "date", "number"), {}, (F.desc_nulls_first("date"), F.desc_nulls_first("number"), F.col("id")))
    return r.page({"limit": "0", "offset": "5"})[0]


@query("flt_p13_not_or", BASE + "SELECT id FROM em WHERE (end_date IS NULL OR end_date >= DATE '2018-01-01') AND NOT (party_id = 1 AND riding_id > 100)")
def not_or(s, d):
    return members(s, d).filter((F.col("end_date").isNull() | (F.col("end_date") >= "2018-01-01")) & ~((F.col("party_id") == 1) & (F.col("riding_id") > 100))).select("id")


@query("flt_p15_p16_dates", BASE + "SELECT id, date FROM vq WHERE year(date) = 2017 AND date >= DATE '2017-12-31' - INTERVAL 200 DAY")
def dates(s, d):
    return questions(s, d).filter((F.year("date") == 2017) & (F.col("date") >= F.date_sub(F.lit("2017-12-31").cast("date"), 200))).select("id", "date")


@query(
    "flt_p21_procedural_rule",
    BASE
    + """SELECT id, (wordcount <= 300 AND ((politician_id IS NULL AND regexp_matches(who_en, '(Speaker|Chair|président)')) OR who_en = ''
    OR content_en NOT LIKE '%<p%' OR NOT regexp_matches(regexp_replace(content_en, '<p[^>]*procedural[^>]*>', '', 'g'), '<p[ >]'))) AS rule
    FROM st WHERE feed <> 'live_captions'""",
)
def procedural_rule(s, d):
    """Short, and spoken by an office without a member, by nobody, or with every paragraph marked procedural."""
    st = statements(s, d, "wordcount", "politician_id", "who_en", "content_en", "feed").filter("feed <> 'live_captions'")
    plain = F.regexp_replace("content_en", "<p[^>]*procedural[^>]*>", "").rlike("<p[ >]")
    office = F.col("politician_id").isNull() & F.col("who_en").rlike("(Speaker|Chair|président)")
    return st.select("id", ((F.col("wordcount") <= 300) & (office | (F.col("who_en") == "") | ~F.col("content_en").contains("<p") | ~plain)).alias("rule"))


# --- joins -------------------------------------------------------------------------------------------------------------


@query("j1_ballot_names", BASE + "SELECT mv.id, pol.name, party.slug, mv.vote FROM mv JOIN em ON em.id = mv.member_id JOIN party ON party.id = em.party_id JOIN pol ON pol.id = mv.politician_id")
def ballot_names(s, d):
    held = members(s, d).select(F.col("id").alias("member_id"), "party_id")
    named = table(s, d, "party").select(F.col("id").alias("party_id"), "slug")
    who = people(s, d).select(F.col("id").alias("politician_id"), "name")
    return ballots(s, d).join(held, "member_id").join(named, "party_id").join(who, "politician_id").select("id", "name", "slug", "vote")


@query("j2_j3_statement_names", BASE + "SELECT st.id, st.who_en, pol.name FROM st LEFT JOIN pol ON pol.id = st.politician_id")
def statement_names(s, d):
    who = people(s, d).select(F.col("id").alias("politician_id"), "name")
    return statements(s, d, "politician_id", "who_en").join(who, "politician_id", "left").select("id", "who_en", "name")


@query("j5_current", BASE + "SELECT id, name FROM pol WHERE EXISTS (SELECT 1 FROM em WHERE em.politician_id = pol.id AND em.end_date IS NULL)")
def current(s, d):
    return people(s, d).join(members(s, d).filter("end_date is null").select(F.col("politician_id").alias("id")), "id", "left_semi").select("id", "name")


@query(
    "j6_former",
    BASE + """SELECT id, name FROM pol WHERE EXISTS (SELECT 1 FROM em WHERE em.politician_id = pol.id)
    AND NOT EXISTS (SELECT 1 FROM em WHERE em.politician_id = pol.id AND em.end_date IS NULL)""",
)
def former(s, d):
    m = members(s, d)
    every, now = (x.select(F.col("politician_id").alias("id")) for x in (m, m.filter("end_date is null")))
    return people(s, d).join(every, "id", "left_semi").join(now, "id", "left_anti").select("id", "name")


@query(
    "j7_member_on_date",
    BASE + """SELECT mv.id, em.id AS held_id, em.party_id, count(*) OVER (PARTITION BY mv.id) > 1 AS ambiguous
    FROM mv JOIN vq ON vq.id = mv.votequestion_id JOIN em ON em.politician_id = mv.politician_id AND em.start_date <= vq.date
    AND (em.end_date IS NULL OR em.end_date >= vq.date)""",
)
def member_on_date(s, d):
    on = ballots(s, d).select("id", "politician_id", "votequestion_id").join(questions(s, d).select(F.col("id").alias("votequestion_id"), "date"), "votequestion_id")
    held = members(s, d).select(F.col("id").alias("held_id"), "politician_id", "party_id", "start_date", "end_date")
    got = joins.in_range(on, held, "date", "start_date", "end_date", on=["politician_id"])
    several = got.groupBy("id").agg((F.count("*") > 1).alias("ambiguous"))
    return got.join(several, "id").select("id", "held_id", "party_id", "ambiguous")


@query(
    "j8_session_of_day",
    BASE + """, cal AS (SELECT session_id, min(date) AS a, max(date) AS b FROM vq GROUP BY session_id),
    days AS (SELECT DISTINCT document_id, CAST(time AS DATE) AS day FROM st)
    SELECT days.document_id, days.day, cal.session_id FROM days LEFT JOIN cal ON days.day BETWEEN cal.a AND cal.b""",
)
def session_of_day(s, d):
    cal = questions(s, d).groupBy("session_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = statements(s, d, "document_id", "time").select("document_id", F.to_date("time").alias("day")).distinct()
    return joins.in_range(days, cal, "day", "a", "b", how="left").select("document_id", "day", "session_id")


@query(
    "j9_latest_membership",
    BASE + "SELECT politician_id, id, party_id FROM (SELECT *, row_number() OVER (PARTITION BY politician_id ORDER BY start_date DESC, id DESC) AS rn FROM em WHERE start_date IS NOT NULL) WHERE rn = 1",
)
def latest_membership(s, d):
    return joins.latest_value(members(s, d).filter("start_date is not null"), ["politician_id"], ["start_date", "id"], ["party_id"]).join(
        members(s, d).filter("start_date is not null").groupBy("politician_id").agg(F.max(F.struct("start_date", "id"))["id"].alias("id")), "politician_id"
    ).select("politician_id", "id", "party_id")


@query(
    "j10_first_in_session",
    BASE + """, cal AS (SELECT session_id, min(date) AS a, max(date) AS b FROM vq GROUP BY session_id)
    SELECT session_id, politician_id, id FROM (SELECT cal.session_id, em.politician_id, em.id, row_number() OVER (PARTITION BY cal.session_id,
    em.politician_id ORDER BY em.start_date DESC, em.id DESC) AS rn FROM em JOIN cal ON em.start_date <= cal.b AND (em.end_date IS NULL OR em.end_date >= cal.a)) WHERE rn = 1""",
)
def first_in_session(s, d):
    cal = questions(s, d).groupBy("session_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    # The calendar has one row per session, some forty in a century.
    got = members(s, d).join(F.broadcast(cal), (F.col("start_date") <= F.col("b")) & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("a"))))
    return joins.latest(got, ["session_id", "politician_id"], F.desc("start_date"), F.desc("id")).select("session_id", "politician_id", "id")


@query("j11_votes_of_bill", BASE + "SELECT a.id AS id, b.id AS other_id FROM vq a JOIN vq b ON a.bill_id = b.bill_id AND a.id < b.id")
def votes_of_bill(s, d):
    q = questions(s, d)
    a, b = q.select("id", "bill_id"), q.select(F.col("id").alias("other_id"), "bill_id")
    return a.join(b, "bill_id").filter("id < other_id").select("id", "other_id")


@query(
    "j22_changed_holders",
    BASE + """, onday AS (SELECT riding_id, politician_id, DATE '2016-06-01' AS day FROM em WHERE start_date <= DATE '2016-06-01' AND (end_date IS NULL OR end_date >= DATE '2016-06-01')
    UNION ALL SELECT riding_id, politician_id, DATE '2018-06-01' FROM em WHERE start_date <= DATE '2018-06-01' AND (end_date IS NULL OR end_date >= DATE '2018-06-01'))
    SELECT DISTINCT a.riding_id, a.politician_id AS before_id, b.politician_id AS after_id FROM onday a JOIN onday b ON a.riding_id = b.riding_id
    WHERE a.day = DATE '2016-06-01' AND b.day = DATE '2018-06-01' AND a.politician_id <> b.politician_id""",
)
def changed_holders(s, d):
    def on(day, name):
        x = F.lit(day).cast("date")
        held = members(s, d).filter((F.col("start_date") <= x) & (F.col("end_date").isNull() | (F.col("end_date") >= x)))
        return held.select("riding_id", F.col("politician_id").alias(name)).distinct()

    return on("2016-06-01", "before_id").join(on("2018-06-01", "after_id"), "riding_id").filter("before_id <> after_id")


@query(
    "j24_follow_slugs",
    BASE + """, links AS (SELECT politician_id AS node, min(id) AS nxt FROM em GROUP BY politician_id), a AS (SELECT DISTINCT id AS node FROM pol),
    b AS (SELECT a.node, COALESCE(l1.nxt, a.node) AS x1 FROM a LEFT JOIN links l1 ON l1.node = a.node),
    c AS (SELECT b.node, COALESCE(l2.nxt, b.x1) AS x2 FROM b LEFT JOIN links l2 ON l2.node = b.x1)
    SELECT node, x2 AS target FROM c""",
)
def follow_slugs(s, d):
    links = members(s, d).groupBy(F.col("politician_id").alias("node")).agg(F.min("id").alias("nxt"))
    return joins.follow(people(s, d).select(F.col("id").alias("node")), links, "node", "nxt", most=2)


@query(
    "j25_changed_party",
    BASE + """SELECT politician_id, id, was, party_id FROM (SELECT politician_id, id, party_id, lag(party_id) OVER (PARTITION BY politician_id ORDER BY start_date, id) AS was,
    lag(id) OVER (PARTITION BY politician_id ORDER BY start_date, id) AS prev FROM em) WHERE prev IS NOT NULL AND was IS DISTINCT FROM party_id""",
)
def changed_party(s, d):
    w = Window.partitionBy("politician_id").orderBy(F.asc_nulls_last("start_date"), "id")
    got = members(s, d).withColumn("was", F.lag("party_id").over(w)).withColumn("prev", F.lag("id").over(w))
    return got.filter(F.col("prev").isNotNull() & ~F.col("was").eqNullSafe(F.col("party_id"))).select("politician_id", "id", "was", "party_id")


@query(
    "j21_preferred_source",
    "SELECT politician_id, taken_on, party_id FROM (SELECT *, row_number() OVER (PARTITION BY politician_id, taken_on ORDER BY (party_id IS NULL), loaded_at DESC, party_id) AS rn FROM member_snapshot) WHERE rn = 1",
)
def preferred_source(s, d):
    """Complete rows beat incomplete ones, then the latest load."""
    return joins.latest(
        table(s, d, "member_snapshot"), ["politician_id", "taken_on"], F.col("party_id").isNull(), F.desc_nulls_last("loaded_at"), F.asc_nulls_last("party_id")
    ).select("politician_id", "taken_on", "party_id")


# --- aggregates over memberships and elections ---------------------------------------------------------------------------


@query("a1_elected_counts", BASE + "SELECT politician_id, count(*) AS n FROM em GROUP BY politician_id HAVING count(*) >= 2")
def elected_counts(s, d):
    return members(s, d).groupBy("politician_id").agg(F.count("*").alias("n")).filter("n >= 2")


@query("a31_same_names", BASE + "SELECT name_family, count(*) AS n FROM pol GROUP BY name_family HAVING count(*) > 1")
def same_names(s, d):
    return people(s, d).groupBy("name_family").agg(F.count("*").alias("n")).filter("n > 1")


_CAND = """WITH c AS (SELECT c_custkey AS candidate_id, c_nationkey AS riding_id, count(o_orderkey) AS votetotal FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey, c_nationkey) """


def _candidacies(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.count("*").alias("votetotal"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_nationkey").alias("riding_id"))
    return c.join(o, "candidate_id", "left").na.fill(0, ["votetotal"])


@query(
    "a10_a11_w6_election",
    _CAND + """SELECT candidate_id, riding_id, votetotal, CAST(votetotal * 100.0 / sum(votetotal) OVER (PARTITION BY riding_id) AS DECIMAL(5,2)) AS votepercent,
    row_number() OVER (PARTITION BY riding_id ORDER BY votetotal DESC, candidate_id) = 1 AS elected FROM c""",
)
def election(s, d):
    c = ranking.share_of_group(_candidacies(s, d), ["riding_id"], "votetotal", "votepercent")
    return ranking.winners(c, ["riding_id"], "votetotal", "candidate_id", "elected").select("candidate_id", "riding_id", "votetotal", "votepercent", "elected")


@query(
    "w1_recent_activity",
    """WITH cap AS (SELECT 'click' AS event_type, 6 AS n UNION ALL SELECT 'view', 8 UNION ALL SELECT 'purchase', 5 UNION ALL SELECT 'error', 7 UNION ALL SELECT 'signup', 6)
    SELECT user_id, event_type, event_id FROM (SELECT e.*, cap.n AS cap, row_number() OVER (PARTITION BY user_id, e.event_type ORDER BY CAST(ts AS DATE) DESC, event_id DESC) AS rn
    FROM events e JOIN cap ON cap.event_type = e.event_type) WHERE rn <= cap""",
)
def recent_activity(s, d):
    """The newest of each kind per person, as many as the kind's cap."""
    cap = F.create_map(*[F.lit(x) for kv in {"click": 6, "view": 8, "purchase": 5, "error": 7, "signup": 6}.items() for x in kv])
    return ranking.top_n(table(s, d, "events"), ["user_id", "event_type"], cap[F.col("event_type")], F.desc(F.to_date("ts")), F.desc("event_id")).select("user_id", "event_type", "event_id")


@query(
    "w2_prune",
    """SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn > 7 AND date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') >= 4""",
)
def prune(s, d):
    """What is beyond the cap and one more (6 + 1), and four days old."""
    got = ranking.numbered(table(s, d, "events"), ["user_id", "event_type"], "rn", F.desc("ts"), F.desc("event_id"))
    return got.filter((F.col("rn") > 7) & (F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")) >= 4)).select("event_id")


@query(
    "w3_first_of_former",
    BASE + """SELECT politician_id, riding_id, id FROM (SELECT em.*, row_number() OVER (PARTITION BY politician_id ORDER BY riding_id, start_date DESC, id) AS rn FROM em
    WHERE politician_id NOT IN (SELECT politician_id FROM em WHERE end_date IS NULL AND politician_id IS NOT NULL)) WHERE rn = 1""",
)
def first_of_former(s, d):
    m = members(s, d)
    old = m.join(m.filter("end_date is null").select("politician_id"), "politician_id", "left_anti")
    return joins.latest(old, ["politician_id"], F.col("riding_id"), F.desc("start_date"), F.col("id")).select("politician_id", "riding_id", "id")


@query("w11_page_of_vote", BASE + "SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY number, id) - 1 AS position, CAST(floor((row_number() OVER (PARTITION BY session_id ORDER BY number, id) - 1) / 15.0) AS BIGINT) + 1 AS page FROM vq")
def page_of_vote(s, d):
    return ranking.page_of(questions(s, d), 15, F.col("number"), F.col("id"), keys=["session_id"]).select("id", "position", "page")


@query("t5_recent_votes", BASE + "SELECT id, date FROM vq ORDER BY date DESC, id DESC LIMIT 6")
def recent_votes(s, d):
    return questions(s, d).select("id", "date").orderBy(F.desc("date"), F.desc("id")).limit(6)


@query("t7_sample", BASE + "SELECT id FROM pol ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 10")
def sample(s, d):
    """A repeatable random sample: the first by hash."""
    return people(s, d).select("id").orderBy(F.md5(F.col("id").cast("string")), "id").limit(10)


@query("t8_autocomplete", BASE + "SELECT id, name FROM pol WHERE lower(name) LIKE 'ma%' OR lower(name_family) LIKE 'ma%' ORDER BY name_family, id LIMIT 15")
def autocomplete(s, d):
    p = people(s, d)
    return p.filter(F.lower("name").startswith("ma") | F.lower("name_family").startswith("ma")).orderBy("name_family", "id").limit(15).select("id", "name")


@query(
    "t9_u1_merged_feed",
    BASE + """SELECT kind, id, day FROM (SELECT 'vote' AS kind, id, date AS day FROM vq UNION ALL SELECT 'text' AS kind, id, day FROM
    (SELECT DISTINCT id, CAST(created AS DATE) AS day FROM bill_text) b) u ORDER BY day DESC, kind, id DESC LIMIT 25""",
)
def merged_feed(s, d):
    v = questions(s, d).select(F.lit("vote").alias("kind"), "id", F.col("date").alias("day"))
    b = once(table(s, d, "bill_text").select("id", F.to_date("created").alias("day")), "id").select(F.lit("text").alias("kind"), "id", "day")
    return v.unionByName(b).orderBy(F.desc("day"), "kind", F.desc("id")).limit(25)


@query("t11_a32_archive", BASE + "SELECT year(date) AS y, month(date) AS m, count(*) AS n, min(date) AS first, max(date) AS last FROM vq GROUP BY year(date), month(date)")
def archive(s, d):
    return questions(s, d).groupBy(F.year("date").alias("y"), F.month("date").alias("m")).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("u3_u4_set_difference", BASE + "SELECT id FROM pol EXCEPT SELECT politician_id FROM em WHERE end_date IS NULL")
def difference(s, d):
    return people(s, d).select("id").subtract(members(s, d).filter("end_date is null").select(F.col("politician_id").alias("id")))


@query(
    "u4_symmetric_difference",
    BASE + """, a AS (SELECT DISTINCT politician_id AS id FROM em), b AS (SELECT DISTINCT politician_id AS id FROM mv)
    SELECT 'office' AS side, id FROM a WHERE id NOT IN (SELECT id FROM b WHERE id IS NOT NULL) UNION ALL SELECT 'ballot', id FROM b WHERE id NOT IN (SELECT id FROM a WHERE id IS NOT NULL)""",
)
def symmetric_difference(s, d):
    a = members(s, d).select(F.col("politician_id").alias("id")).filter("id is not null").distinct()
    b = ballots(s, d).select(F.col("politician_id").alias("id")).filter("id is not null").distinct()
    return a.join(b, "id", "left_anti").select(F.lit("office").alias("side"), "id").unionByName(b.join(a, "id", "left_anti").select(F.lit("ballot").alias("side"), "id"))


@query("a30_attributes", "SELECT user_id, event_type, max_value FROM (SELECT user_id, event_type, value AS max_value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def attributes(s, d):
    """Attribute rows as a map per entity, the last value of a key wins; given here as rows again."""
    last = table(s, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    maps = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("event_type", "max_value"))


@query("n1_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("n3_code_map", BASE + "SELECT id, CASE vote WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' WHEN 'P' THEN 'Paired' ELSE vote END AS label FROM mv")
def code_map(s, d):
    m = F.create_map(*[F.lit(x) for x in ("Y", "Yes", "N", "No", "P", "Paired")])
    return ballots(s, d).select("id", F.coalesce(F.try_element_at(m, F.col("vote")), F.col("vote")).alias("label"))


@query("k2_changes", """WITH a AS (SELECT politician_id, max(party_id) AS p FROM member_snapshot WHERE taken_on < DATE '2017-01-01' GROUP BY politician_id),
    b AS (SELECT politician_id, max(party_id) AS p FROM member_snapshot WHERE taken_on >= DATE '2017-01-01' GROUP BY politician_id)
    SELECT COALESCE(a.politician_id, b.politician_id) AS politician_id, COALESCE(b.p, a.p) AS party_id, (b.p IS NOT NULL AND a.p IS DISTINCT FROM b.p) AS changed
    FROM a FULL JOIN b ON a.politician_id = b.politician_id""")  # fmt: skip
def changes(s, d):
    """Upsert that sets only values which are there and differ."""
    snap = table(s, d, "member_snapshot")
    cut = F.lit("2017-01-01").cast("date")
    a = snap.filter(F.col("taken_on") < cut).groupBy("politician_id").agg(F.max("party_id").alias("a"))
    b = snap.filter(F.col("taken_on") >= cut).groupBy("politician_id").agg(F.max("party_id").alias("b"))
    return a.join(b, "politician_id", "full").select(
        "politician_id", F.coalesce("b", "a").alias("party_id"), (F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed")
    )


QUERIES, ORACLE = REGISTRY.queries, REGISTRY.sql
