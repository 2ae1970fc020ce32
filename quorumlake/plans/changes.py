"""Changes of tables, names resolved, pages, alerts, search and corpora, with SQL (ids K, J16-J19, J27, T3, T4, G, Q, P27, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.catalog import once, table
from quorumlake.functions import text as tx
from quorumlake.operators import corpora, paging, resolve, search, writes
from quorumlake.plans.debates import _BM, SAID, _said
from quorumlake.plans.lists import MORE, debates
from quorumlake.plans.records import BASE, ballots, members, people, questions, statements
from quorumlake.plans.registry import Registry
from quorumlake.session import shared_dir
from quorumlake.streaming import jobs

REGISTRY = Registry()
query = REGISTRY.query


def _day(text: str):
    return F.lit(text).cast("date")


# --- changes of tables ----------------------------------------------------------------------------------------------------------


@query("k1_upsert", BASE + ", old AS (SELECT politician_id, riding_id, min(id) AS id FROM em WHERE start_date < DATE '2016-01-01' GROUP BY politician_id, riding_id), new AS (SELECT politician_id, riding_id, min(id) AS id FROM em GROUP BY politician_id, riding_id) SELECT politician_id, riding_id, id, false AS created FROM old UNION ALL SELECT politician_id, riding_id, id, true FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.politician_id = new.politician_id AND old.riding_id IS NOT DISTINCT FROM new.riding_id)")
def upsert(s, d):
    """Who held which riding before a day, and those added since."""
    m = members(s, d).select("politician_id", "riding_id", "id", "start_date")
    old = m.filter(F.col("start_date") < "2016-01-01").groupBy("politician_id", "riding_id").agg(F.min("id").alias("id"))
    return writes.insert_missing(old, m, ["politician_id", "riding_id"])


@query("k4_k19_update", BASE + "SELECT id, CASE WHEN end_date IS NULL AND riding_id % 2 = 0 THEN DATE '2019-10-21' ELSE end_date END AS end_date, CASE WHEN id = 3 THEN NULL ELSE party_id END AS party_id FROM em")
def update(s, d):
    m = members(s, d).select("id", "riding_id", "end_date", "party_id")
    m = writes.update_where(m, F.col("end_date").isNull() & (F.col("riding_id") % 2 == 0), {"end_date": _day("2019-10-21")})
    return writes.update_where(m, F.col("id") == 3, {"party_id": F.lit(None).cast("long")}).select("id", "end_date", "party_id")


@query("k5_delete", BASE + "SELECT id, votequestion_id FROM pv WHERE votequestion_id NOT IN (SELECT id FROM vq WHERE bill_id IS NULL)")
def delete(s, d):
    doomed = questions(s, d).filter("bill_id is null").select(F.col("id").alias("votequestion_id"))
    return writes.delete_keys(once(table(s, d, "party_vote"), "id").select("id", "votequestion_id"), doomed, ["votequestion_id"])


@query("k3_k6_replace_document", BASE + ", r AS (SELECT max(document_id) AS x FROM st WHERE feed = 'gazette_txt') SELECT id, document_id, sequence FROM st WHERE document_id NOT IN (SELECT document_id FROM st WHERE feed = 'gazette_txt') UNION ALL SELECT id + 1000000, document_id, sequence FROM st WHERE feed = 'gazette_txt'")
def replace_document(s, d):
    """The documents of one feed imported again, their statements under new ids."""
    st = statements(s, d, "document_id", "sequence", "feed")
    again = st.filter("feed = 'gazette_txt'").withColumn("id", F.col("id") + 1_000_000)
    return writes.replace_documents(st.select("id", "document_id", "sequence"), again, "document_id")


@query("k17_reopen_membership", BASE + """, w AS (SELECT DISTINCT politician_id, riding_id, party_id, DATE '2017-01-03' AS d FROM em WHERE start_date < DATE '2016-06-01' AND politician_id IS NOT NULL AND riding_id IS NOT NULL AND party_id IS NOT NULL),
    j AS (SELECT em.*, w.d FROM em LEFT JOIN w ON w.politician_id = em.politician_id AND w.riding_id = em.riding_id AND w.party_id = em.party_id), g AS (SELECT *, d IS NOT NULL AND (end_date IS NULL OR end_date = d) AS goes FROM j)
    SELECT id, politician_id, riding_id, party_id, start_date, CASE WHEN goes THEN NULL ELSE end_date END AS end_date FROM g
    UNION ALL SELECT (SELECT max(id) FROM em) + row_number() OVER (ORDER BY politician_id, riding_id, party_id), politician_id, riding_id, party_id, d, NULL FROM w WHERE NOT EXISTS (SELECT 1 FROM g WHERE goes AND g.politician_id = w.politician_id AND g.riding_id = w.riding_id AND g.party_id = w.party_id)""")  # fmt: skip
def reopen(s, d):
    """Everyone who held a seat before a day wins it again on another."""
    m = members(s, d).select("id", "politician_id", "riding_id", "party_id", "start_date", "end_date")
    won = m.filter(F.col("start_date") < "2016-06-01").dropna(subset=["politician_id", "riding_id", "party_id"]).select("politician_id", "riding_id", "party_id", _day("2017-01-03").alias("date")).distinct()
    return writes.reopen_memberships(m, won)


@query("k18_placeholders", "SELECT bill_id, min(docid) AS docid, false AS stub FROM bill_text WHERE docid % 2 = 0 GROUP BY bill_id UNION ALL SELECT DISTINCT bill_id, CAST(NULL AS BIGINT), true FROM vote_question WHERE bill_id IS NOT NULL AND bill_id NOT IN (SELECT bill_id FROM bill_text WHERE docid % 2 = 0)")
def placeholders(s, d):
    """Bills with a text of an even number, and a stub for every other bill that was voted on."""
    have = table(s, d, "bill_text").filter("docid % 2 = 0").groupBy("bill_id").agg(F.min("docid").alias("docid")).withColumn("stub", F.lit(False))
    return writes.with_placeholders(have, questions(s, d), "bill_id", {"stub": F.lit(True)})


@query("g11_versions", BASE + "SELECT session_id || '-' || CAST(min(number) AS VARCHAR) AS key, min(number) AS number, false AS public FROM vq GROUP BY session_id UNION ALL SELECT session_id, max(number), true FROM vq GROUP BY session_id")
def versions(s, d):
    """A summary per session made anew: the old one is kept under a suffix, out of sight."""
    q = questions(s, d).groupBy(F.col("session_id").alias("key")).agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    old = q.select("key", F.col("lo").alias("number"), F.lit(True).alias("public"))
    return writes.archived(old, q.select("key", F.col("hi").alias("number")), "key", F.col("number").cast("string"))


_SUBS = "subs AS (SELECT DISTINCT user_id, event_type AS topic FROM events WHERE user_id % 3 = 0)"


@query("k11_messages", f"WITH {_SUBS}, it AS (SELECT event_type AS topic, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT s.user_id AS user, s.topic, 'New: ' || s.topic AS subject, string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id) AS body FROM it JOIN subs s ON s.topic = it.topic WHERE rn <= 25 GROUP BY s.user_id, s.topic")
def messages(s, d):
    """What goes out after a run: a message per topic and subscriber with the newest items."""
    e = table(s, d, "events")
    hits = e.select(F.col("event_type").alias("topic"), F.col("event_id").alias("item"), F.col("ts").alias("at"))
    subs = e.filter("user_id % 3 = 0").select(F.col("user_id").alias("user"), F.col("event_type").alias("topic")).distinct()
    new = jobs.new_items(hits, s.createDataFrame([], "topic string, item long"))
    return writes.outgoing(new, subs, "topic", F.concat(F.lit("New: "), F.first("topic")), F.col("item").cast("string"), F.col("item"))


# --- names --------------------------------------------------------------------------------------------------------------------


_NORM = f"replace(replace(trim(regexp_replace(translate(lower(regexp_replace({{0}}, '^(Right Hon\\.|Hon\\.|Mr\\.|Mrs\\.|Ms\\.|Miss|Dr\\.|Mme|M\\.) +', '')), '{tx.ACCENTED}', '{tx.PLAIN}'), '[\\s\\x{{{{00A0}}}}]+', ' ', 'g')), '’', ''''), '‘', '''')"


@query("j16_resolve_names", BASE + f""", cal AS (SELECT session_id, min(date) AS a, max(date) AS b FROM vq GROUP BY session_id), held AS (SELECT DISTINCT politician_id, session_id, riding_id, party_id FROM em JOIN cal ON em.start_date <= cal.b AND (em.end_date IS NULL OR em.end_date >= cal.a)),
    ask AS (SELECT st.id AS key, regexp_replace(who_en, ' ?[(\\[—].*$', '') AS name, CASE WHEN st.id % 3 = 0 THEN NULL ELSE '41-1' END AS session, CASE WHEN st.id % 3 = 2 THEN em.riding_id END AS riding_id FROM st LEFT JOIN em ON em.id = st.member_id WHERE feed <> 'live_captions'),
    n AS (SELECT *, {_NORM.format('name')} AS nn FROM ask), c AS (SELECT n.*, pol.id AS pid FROM n JOIN pol ON {_NORM.format('pol.name')} = nn),
    f AS (SELECT DISTINCT key, pid FROM c WHERE session IS NULL AND riding_id IS NULL UNION SELECT DISTINCT c.key, pid FROM c JOIN held h ON h.politician_id = pid AND (c.session IS NULL OR c.session = h.session_id) AND (c.riding_id IS NULL OR c.riding_id = h.riding_id) WHERE NOT (c.session IS NULL AND c.riding_id IS NULL)),
    one AS (SELECT key, count(*) AS n, min(pid) AS pid FROM f GROUP BY key), l AS (SELECT *, regexp_extract(trim(name), '\\s([A-Z][\\w-]+)$', 1) AS fam FROM n WHERE session IS NOT NULL AND key NOT IN (SELECT key FROM one)),
    g AS (SELECT DISTINCT l.key, pol.id AS pid, l.riding_id IS NOT NULL AS err FROM l JOIN pol ON pol.name_family = fam JOIN held h ON h.politician_id = pol.id AND h.session_id = l.session AND (l.riding_id IS NULL OR l.riding_id = h.riding_id) WHERE fam <> ''),
    two AS (SELECT key, count(*) AS n, min(pid) AS pid, bool_or(err) AS err FROM g GROUP BY key), al AS (SELECT key, n, pid, 'alias' AS stage, true AS err FROM one UNION ALL SELECT key, n, pid, 'surname', err FROM two)
    SELECT ask.key, CASE WHEN n = 1 THEN pid END AS politician_id, CASE WHEN n = 1 OR err THEN stage END AS stage, CASE WHEN n = 1 THEN NULL WHEN n > 1 AND err THEN 'ambiguous' ELSE 'unknown' END AS problem FROM ask LEFT JOIN al ON al.key = ask.key""")  # fmt: skip
def resolve_names(s, d):
    """Every speaker's label: a third by the name alone, a third within a session, a third within a session and riding."""
    m = members(s, d)
    cal = questions(s, d).groupBy(F.col("session_id").alias("session")).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    held = m.join(F.broadcast(cal), (F.col("start_date") <= F.col("b")) & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("a"))))  # one row per session
    st = _said(s, d, "who_en", "member_id").join(m.select(F.col("id").alias("member_id"), F.col("riding_id").alias("_r")), "member_id", "left")
    asked = st.select(
        F.col("id").alias("key"), F.regexp_replace("who_en", r" ?[(\[—].*$", "").alias("name"), F.when(F.col("id") % 3 != 0, "41-1").alias("session"),
        F.when(F.col("id") % 3 == 2, F.col("_r")).alias("riding_id"), F.lit(None).cast("long").alias("party_id"),
    )
    p = people(s, d)
    return resolve.people_by_name(asked, p.select(F.col("id").alias("politician_id"), "name"), held.select("politician_id", "session", "riding_id", "party_id"), p)


@query("j17_candidates", BASE + f""", ran AS (SELECT DISTINCT politician_id, riding_id % 5 AS province, party_id FROM em), ask AS (SELECT em.id AS key, CASE WHEN em.id % 2 = 0 THEN pol.name_given || ' James' ELSE pol.name_given END AS f, pol.name_family AS l, em.riding_id % 5 AS province, CASE WHEN em.id % 5 = 0 THEN em.party_id + 1 ELSE em.party_id END AS party_id FROM em JOIN pol ON pol.id = em.politician_id),
    a AS (SELECT ask.*, pol.id AS pid FROM ask JOIN pol ON {_NORM.format("ask.f || ' ' || ask.l")} = {_NORM.format('pol.name')}), b AS (SELECT ask.*, pol.id AS pid FROM ask JOIN pol ON {_NORM.format("string_split(ask.f, ' ')[1] || ' ' || ask.l")} = {_NORM.format('pol.name')} WHERE contains(ask.f, ' ') AND ask.key NOT IN (SELECT key FROM a)),
    h AS (SELECT u.key, count(DISTINCT pid) AS n, min(pid) AS pid FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u JOIN ran ON ran.politician_id = pid AND ran.province = u.province AND ran.party_id = u.party_id GROUP BY u.key)
    SELECT ask.key, CASE WHEN h.n = 1 THEN h.pid END AS politician_id, CASE WHEN h.n > 1 THEN 'ambiguous' END AS problem FROM ask LEFT JOIN h ON h.key = ask.key""")  # fmt: skip
def candidates(s, d):
    """Every member as a candidate, half of them with a second given name, a fifth for another party; a province is made of the riding."""
    m, p = members(s, d), people(s, d)
    asked = m.join(p.select(F.col("id").alias("politician_id"), "name_given", "name_family"), "politician_id").select(
        F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, F.concat("name_given", F.lit(" James"))).otherwise(F.col("name_given")).alias("first"), F.col("name_family").alias("last"),
        (F.col("riding_id") % 5).alias("province"), F.when(F.col("id") % 5 == 0, F.col("party_id") + 1).otherwise(F.col("party_id")).alias("party_id"),
    )
    return resolve.candidates_by_name(asked, p.select(F.col("id").alias("politician_id"), "name"), m.select("politician_id", (F.col("riding_id") % 5).alias("province"), "party_id"))


@query("j19_ridings", BASE + "SELECT DISTINCT riding_id, CASE riding_id % 4 WHEN 0 THEN 'vancouver-east' WHEN 1 THEN 'lac-saint-jean' WHEN 2 THEN 'saint-hubert' ELSE 'riding-north' END AS slug FROM em WHERE riding_id IS NOT NULL")
def ridings(s, d):
    """Names as they are misspelt, in turn over the ridings, which have no names here."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("Vancouver Est", "Lac-St-Jean", "Sint-Hubert", "Riding North")]), (F.col("riding_id") % 4 + 1).cast("int"))
    return members(s, d).filter("riding_id is not null").select("riding_id").distinct().select("riding_id", resolve.riding_slug(name).alias("slug"))


@query("j27_subscriptions", "WITH subs AS (SELECT DISTINCT user_id, event_type AS topic FROM events), prior AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT subs.user_id, subs.topic, COALESCE(prior.n, 0) AS earlier FROM subs LEFT JOIN prior ON prior.user_id = subs.user_id WHERE subs.topic <> 'error'")
def subscriptions(s, d):
    """Topics of every user with the alerts the user had before."""
    e = table(s, d, "events")
    subs = e.filter("event_type <> 'error'").select("user_id", F.col("event_type").alias("topic")).distinct()
    prior = e.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    return subs.join(prior, "user_id", "left").select("user_id", "topic", F.coalesce("n", F.lit(0)).alias("earlier"))


# --- views and pages ------------------------------------------------------------------------------------------------------------


@query("s4_documents_without_statements", "SELECT doc_id FROM documents WHERE doc_kind = 'evidence' AND NOT EXISTS (SELECT 1 FROM statement WHERE statement.document_id = documents.doc_id)")
def unparsed(s, d):
    have = table(s, d, "statement").select(F.col("document_id").alias("doc_id"))
    return table(s, d, "documents").filter("doc_kind = 'evidence'").join(have, "doc_id", "left_anti").select("doc_id")


@query("s5_active", BASE + "SELECT id FROM em WHERE end_date IS NULL OR end_date > DATE '2018-06-30'")
def active(s, d):
    """The view of what is public: here memberships that are open on a day."""
    return members(s, d).withColumn("active", F.col("end_date").isNull() | (F.col("end_date") > "2018-06-30")).filter("active").select("id")


@query("t3_m3_pages", BASE + "SELECT id, pg.p AS page FROM (SELECT *, row_number() OVER (ORDER BY date DESC, id) AS rn FROM vq) q, (SELECT CAST(greatest(1, ceil(count(*) / 15.0)) AS INTEGER) AS p FROM vq) pg WHERE rn > (pg.p - 1) * 15 AND rn <= pg.p * 15")
def last_page(s, d):
    """A page beyond the last is the last."""
    q = questions(s, d).select("id", "date")
    pages = q.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 15)).cast("int").alias("page"))
    return paging.page_rows(q, "9999", 15, F.desc("date"), F.col("id")).crossJoin(F.broadcast(pages)).select("id", "page")  # one row


@query("t4_page_numbers", """WITH p AS (SELECT DISTINCT CAST(event_id % 40 AS INTEGER) AS pages, CAST(event_id % 40 // 3 + 1 AS INTEGER) AS page FROM events),
    r AS (SELECT pages, page, CASE WHEN pages <= 1 THEN [] WHEN pages <= 11 THEN range(1, pages + 1) WHEN page <= 6 THEN range(1, 9) WHEN page > pages - 6 THEN range(greatest(1, pages - 7), pages + 1) ELSE range(greatest(1, page - 2), least(pages, page + 2) + 1) END AS shown,
      CASE WHEN pages <= 11 OR page <= 6 THEN [] ELSE [1, 2] END AS before, CASE WHEN pages <= 11 OR (page > 6 AND page > pages - 6) THEN [] ELSE [pages, pages - 1] END AS after FROM p)
    SELECT pages, page, array_to_string(before, ' ') AS before, array_to_string(shown, ' ') AS shown, array_to_string(after, ' ') AS after FROM r""")  # fmt: skip
def page_numbers(s, d):
    p = table(s, d, "events").select((F.col("event_id") % 40).cast("int").alias("pages")).distinct().withColumn("page", F.floor(F.col("pages") / 3).cast("int") + 1)
    p = p.withColumn("x", paging.page_numbers(F.col("page"), F.col("pages")))
    return p.select("pages", "page", *[F.array_join(F.col(f"x.{c}"), " ").alias(c) for c in ("before", "shown", "after")])


# --- alerts ---------------------------------------------------------------------------------------------------------------------


@query("g3_g5_alert_runs", """WITH h AS (SELECT event_type AS topic, event_id AS item, ts FROM events), a AS (SELECT topic, item, row_number() OVER (PARTITION BY topic ORDER BY ts DESC, item DESC) AS rn FROM h WHERE ts < TIMESTAMP '2024-01-15 00:00:00'),
    b AS (SELECT topic, item, row_number() OVER (PARTITION BY topic ORDER BY ts DESC, item DESC) AS rn FROM h) SELECT topic, item FROM b WHERE rn <= 25 AND NOT EXISTS (SELECT 1 FROM a WHERE a.rn <= 40 AND a.topic = b.topic AND a.item = b.item)""")  # fmt: skip
def alert_runs(s, d):
    """A topic begins with its newest forty marked as seen; the next run sends what is new among the newest 25."""
    hits = table(s, d, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("item"), F.col("ts").alias("at"))
    seen = jobs.new_items(hits.filter(F.col("at") < F.lit("2024-01-15").cast("timestamp_ntz")), s.createDataFrame([], "topic string, item long"), limit=40)
    return jobs.new_items(hits, seen).select("topic", "item")


@query("g4_without_chair", BASE + "SELECT id FROM st WHERE NOT (statement_type <> 'witness' AND contains(who_en, 'Speaker') AND length(content_en) <= 1200)")
def without_chair(s, d):
    st = statements(s, d, "who_en", "content_en", "statement_type")
    return jobs.without_chair(st, F.col("statement_type") != "witness", "who_en", "content_en").select("id")


@query("g14_former_members", BASE + """, al AS (SELECT id AS alert_id, id AS politician_id FROM pol WHERE id % 7 <> 0), l AS (SELECT politician_id, riding_id FROM (SELECT *, row_number() OVER (PARTITION BY politician_id ORDER BY start_date DESC NULLS LAST, riding_id DESC) AS rn FROM em) WHERE rn = 1)
    SELECT al.alert_id, al.politician_id, l.riding_id, n.politician_id AS new_politician_id FROM al JOIN l ON l.politician_id = al.politician_id JOIN em n ON n.riding_id = l.riding_id AND n.end_date IS NULL WHERE NOT EXISTS (SELECT 1 FROM em WHERE em.politician_id = al.politician_id AND em.end_date IS NULL)""")  # fmt: skip
def former_members(s, d):
    al = people(s, d).select(F.col("id").alias("alert_id"), F.col("id").alias("politician_id"), (F.col("id") % 7 != 0).alias("active"))
    return jobs.former_members(al, members(s, d).select("politician_id", "riding_id", "start_date", "end_date"))


@query("a33_grouped_subscribers", f"WITH {_SUBS} SELECT topic, count(*) AS users, string_agg(CAST(user_id AS VARCHAR), ' ' ORDER BY user_id) AS who FROM subs GROUP BY topic")
def subscribers(s, d):
    """The subscribers of each topic: ids only, packed by hash first would change nothing, as the list is the result."""
    subs = table(s, d, "events").filter("user_id % 3 = 0").select("user_id", F.col("event_type").alias("topic")).distinct()
    return subs.groupBy("topic").agg(F.count("*").alias("users"), F.array_join(F.transform(F.sort_array(F.collect_list("user_id")), lambda x: x.cast("string")), " ").alias("who"))


# --- search -----------------------------------------------------------------------------------------------------------------------


@query("q3_match_all", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE source = 'petitions' AND doc_kind = 'report'")
def match_all(s, d):
    """Filters without a word: all that fits."""
    docs = table(s, d, "documents")
    asked = search.parse('Source: "petitions" Kind: "report"', {"Source", "Kind"})
    return search.found(docs, search.postings(docs, "doc_id", "text"), asked, {"Source": "source", "Kind": "doc_kind"}, "doc_id")


@query("q6_sorted_hits", _BM + "SELECT sc.doc_id, published_on FROM sc JOIN documents dd ON dd.doc_id = sc.doc_id ORDER BY published_on ASC NULLS LAST, sc.doc_id LIMIT 20")
def sorted_hits(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", F.col("published_on").alias("date"))
    hits = search.ranked(search.postings(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n")), ["carbon", "storage", "petition"], "doc_id")
    return hits.join(docs.select("doc_id", "date"), "doc_id").orderBy(*search.ordered(hits, "date asc", "doc_id")).limit(20).select("doc_id", F.col("date").alias("published_on"))


@query("q10_redirects", BASE + f"SELECT query, min(url) AS url FROM (SELECT name AS query, '/politicians/' || slug || '/' AS url, count(*) OVER (PARTITION BY translate(lower(name), '{tx.ACCENTED}', '{tx.PLAIN}')) AS n FROM pol) WHERE n = 1 GROUP BY query UNION ALL SELECT 'k1a 0b' || CAST(em.riding_id % 10 AS VARCHAR), '/politicians/' || min_by(slug, pol.id) || '/' FROM em JOIN pol ON pol.id = em.politician_id WHERE em.end_date IS NULL AND em.riding_id IS NOT NULL GROUP BY em.riding_id % 10")
def redirects(s, d):
    """Every person's name and ten postal codes, each of the ridings with one last digit."""
    p, m = people(s, d), members(s, d).filter("end_date is null and riding_id is not null").select("riding_id", "politician_id")
    last = (F.col("riding_id") % 10).cast("string")
    codes = m.select(F.concat(F.lit("K1A0B"), last).alias("code"), "riding_id").distinct()
    raw = p.select(F.col("name").alias("query")).distinct().unionByName(m.select(F.concat(F.lit("k1a 0b"), last).alias("query")).distinct())
    return search.redirect(raw, p, codes, m)


@query("q12_feed", BASE + "SELECT id, time FROM st WHERE contains(lower(content_en), 'carbon') AND contains(lower(content_en), 'storage') ORDER BY time DESC NULLS LAST, id LIMIT 25")
def feed(s, d):
    """The newest statements with all the words."""
    c = F.lower("content_en")
    return statements(s, d, "content_en", "time").filter(c.contains("carbon") & c.contains("storage")).orderBy(F.desc_nulls_last("time"), "id").limit(25).select("id", "time")


# --- corpora ------------------------------------------------------------------------------------------------------------------------


_CORPORA = MORE + """, x AS (SELECT id, document_id, time, CASE WHEN feed = 'committee_xml' THEN 'E' ELSE 'D' END AS document_type FROM st),
    co AS (SELECT DISTINCT 'c-' || CAST(document_id % 4 AS VARCHAR) AS committee, document_id FROM x WHERE document_type = 'E' AND document_id IN (SELECT id FROM deb WHERE date >= DATE '2018-01-01' - 1095)),
    corpus AS (SELECT 'default' AS corpus, id FROM x WHERE time >= TIMESTAMP '2018-01-01 00:00:00' - INTERVAL 365 DAY UNION ALL SELECT 'debates', id FROM x WHERE document_type = 'D' AND time >= TIMESTAMP '2018-01-01 00:00:00' - INTERVAL 365 DAY
      UNION ALL SELECT 'debates-' || CAST(year(time) AS VARCHAR), id FROM x WHERE document_type = 'D' AND year(time) BETWEEN 1994 AND 2017 UNION ALL SELECT co.committee, x.id FROM x JOIN co ON co.document_id = x.document_id) """


def _corpora(s, d, *cols):
    st = statements(s, d, "document_id", "time", "feed", *cols)
    st = st.withColumn("document_type", F.when(F.col("feed") == "committee_xml", "E").otherwise("D"))
    days = debates(s, d).select(F.col("id").alias("document_id"), "date")
    co = st.filter("document_type = 'E'").select(F.concat(F.lit("c-"), (F.col("document_id") % 4).cast("string")).alias("committee"), "document_id").distinct().join(days, "document_id")
    return corpora.corpora(st, _day("2018-01-01"), co)


@query("flt_p27_corpora", _CORPORA + "SELECT corpus, count(*) AS n FROM corpus GROUP BY corpus")
def corpus_sizes(s, d):
    """Statements of every corpus as of a day; four committees are made of the documents of one feed."""
    return _corpora(s, d).groupBy("corpus").agg(F.count("*").alias("n"))


@query("s22_k12_h4_models", _CORPORA + r""", t AS (SELECT c.corpus, regexp_split_to_array(regexp_replace(lower(st.h2_en), '[^\s\p{L}\p{N}_''’—-]', '', 'g'), '[\s—]+') AS w FROM corpus c JOIN st ON st.id = c.id WHERE c.corpus = 'debates-2017'),
    g AS (SELECT w[i] || ' ' || w[i + 1] AS gram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t)), c2 AS (SELECT gram, count(*) AS cnt FROM g WHERE length(gram) > 2 AND gram NOT LIKE '%/%' GROUP BY gram)
    SELECT gram, cnt, CAST(cnt AS DOUBLE) / (SELECT sum(cnt) FROM c2) AS p FROM c2 WHERE cnt >= 5""")  # fmt: skip
def stored_models(s, d):
    """The models of all corpora stored, and the two-word one of a year loaded again; of headings, which are short."""
    import uuid

    path = f"{shared_dir(s)}/models-{uuid.uuid4().hex}"
    corpora.store(corpora.models(_corpora(s, d, "h2_en"), "h2_en"), path)
    return corpora.load(s, path, "debates-2017", 2)


# --- debates ------------------------------------------------------------------------------------------------------------------------


@query("a21_r1_by_party", SAID + """, j AS (SELECT sd.id, sd.document_id, COALESCE(party.short_name_en, '') AS party, COALESCE(em.party_id, 0) AS pid, sd.time, sd.sequence FROM sd LEFT JOIN em ON em.id = sd.member_id LEFT JOIN party ON party.id = em.party_id WHERE h1_en = 'Oral Questions')
    SELECT id, document_id, party, row_number() OVER (PARTITION BY document_id, party ORDER BY pid, time, sequence) AS position FROM j""")  # fmt: skip
def by_party(s, d):
    """Statements of question period by party, each with its place in the party's order: rows, since a party may hold most of them."""
    from quorumlake.operators import ranking

    p = table(s, d, "party").select(F.col("id").alias("party_id"), F.col("short_name_en").alias("party"))
    m = members(s, d).select(F.col("id").alias("member_id"), "party_id").join(F.broadcast(p), "party_id", "left")  # fixed, 7 rows
    st = _said(s, d, "h1_en", "member_id", "time").filter("h1_en = 'Oral Questions'").join(m, "member_id", "left").na.fill({"party": "", "party_id": 0})
    return ranking.numbered(st, ["document_id", "party"], "position", F.col("party_id"), F.col("time"), F.col("sequence")).select("id", "document_id", "party", "position")


@query("a25_party_words", SAID + """SELECT document_id, COALESCE(party.short_name_en, '') AS party, CAST(sum(wordcount) AS BIGINT) AS words, CASE WHEN sum(wordcount) > 1500 THEN 'long' WHEN sum(wordcount) > 200 THEN 'medium' ELSE 'short' END AS size
    FROM sd LEFT JOIN em ON em.id = sd.member_id LEFT JOIN party ON party.id = em.party_id WHERE h1_en = 'Oral Questions' AND NOT procedural GROUP BY document_id, COALESCE(party.short_name_en, '')""")  # fmt: skip
def party_words(s, d):
    """Words of question period by party, and how long an account of them would be."""
    p = table(s, d, "party").select(F.col("id").alias("party_id"), F.col("short_name_en").alias("party"))
    m = members(s, d).select(F.col("id").alias("member_id"), "party_id").join(F.broadcast(p), "party_id", "left")  # fixed, 7 rows
    st = _said(s, d, "h1_en", "member_id", "wordcount", "procedural").filter("h1_en = 'Oral Questions' and not procedural").join(m, "member_id", "left").na.fill({"party": ""})
    got = st.groupBy("document_id", "party").agg(F.sum("wordcount").alias("words"))
    return got.withColumn("size", F.when(F.col("words") > 1500, "long").when(F.col("words") > 200, "medium").otherwise("short"))


@query("u2_link_sets", BASE + """, a AS (SELECT votequestion_id, list(DISTINCT politician_id) AS x FROM mv WHERE vote = 'Y' GROUP BY votequestion_id), b AS (SELECT votequestion_id, list(DISTINCT politician_id) AS x FROM mv WHERE dissent GROUP BY votequestion_id)
    SELECT votequestion_id, id AS politician_id FROM (SELECT a.votequestion_id, unnest(list_filter(a.x, lambda i: NOT list_contains(COALESCE(b.x, []), i))) AS id FROM a LEFT JOIN b ON b.votequestion_id = a.votequestion_id)""")  # fmt: skip
def link_sets(s, d):
    """What one set of links has and the other lacks, by an anti-join on (key, link): no set is gathered."""
    b = ballots(s, d).select("votequestion_id", "politician_id", "vote", "dissent")
    return b.filter("vote = 'Y'").select("votequestion_id", "politician_id").distinct().join(b.filter("dissent"), ["votequestion_id", "politician_id"], "left_anti")


QUERIES, ORACLE = REGISTRY.queries, REGISTRY.sql
