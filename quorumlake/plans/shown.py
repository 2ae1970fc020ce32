"""What pages and indexes show of debates and people, with SQL (ids A23, A36, F25, F27, F32, F38, H1, J26, K14, P23, S24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.catalog import table
from quorumlake.functions import markup as mk
from quorumlake.functions import text as tx
from quorumlake.operators import debates as db
from quorumlake.operators import search
from quorumlake.plans.debates import SAID, _said, _sectioned
from quorumlake.plans.lists import MORE, bills
from quorumlake.plans.records import BASE, members, people, questions, statements
from quorumlake.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


@query(
    "a23_w8_headings",
    SAID + """, a AS (SELECT document_id, sequence, slug, h2_en, lag(h2_en) OVER (PARTITION BY document_id ORDER BY sequence) AS p FROM sd WHERE h2_en IS NOT NULL AND h2_en <> ''),
    b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> h2_en THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY sequence) AS position FROM a)
    SELECT document_id, CAST(position AS BIGINT) AS position, min(h2_en) AS heading, arg_min(slug, sequence) AS slug FROM b GROUP BY document_id, position
    UNION ALL SELECT document_id, 0, 'Question Period', arg_min(slug, sequence) FROM sd WHERE h1_en = 'Oral Questions' GROUP BY document_id""",
)
def topics(s, d):
    """The topics of a sitting, question period before them."""
    return db.topics(_sectioned(_said(s, d, "time", "slug", "h1_en", "h2_en", "wordcount", "procedural")), "h2", True)


@query("k14_transcripts", SAID + """, x AS (SELECT document_id, sequence, 'Name: ' || who_en || chr(10) || 'URL: /s/' || CAST(sd.id AS VARCHAR) || chr(10) || CASE WHEN em.id IS NULL THEN '' ELSE 'Party: ' || party.short_name_en || chr(10) || 'Riding: ' || CAST(em.riding_id AS VARCHAR) || chr(10) END
      || CASE WHEN COALESCE(who_context_en, '') = '' THEN '' ELSE 'Title: ' || who_context_en || chr(10) END || chr(10) || chr(10) || COALESCE(content_en, '') AS b FROM sd LEFT JOIN em ON em.id = sd.member_id LEFT JOIN party ON party.id = em.party_id)
    SELECT document_id, string_agg(b, chr(10) || chr(10) || '----' || chr(10) || chr(10) ORDER BY sequence) AS text FROM x GROUP BY document_id""")  # fmt: skip
def transcripts(s, d):
    p = table(s, d, "party").select(F.col("id").alias("party_id"), F.col("short_name_en").alias("party"))
    m = members(s, d).join(F.broadcast(p), "party_id", "left").select(F.col("id").alias("member_id"), "party", F.col("riding_id").cast("string").alias("riding"))  # fixed, 7 rows
    st = _said(s, d, "who_en", "who_context_en", "content_en", "member_id").join(m, "member_id", "left")
    st = st.select("document_id", "sequence", F.col("who_en").alias("name"), F.concat(F.lit("/s/"), F.col("id").cast("string")).alias("url"), "party", "riding", F.nullif("who_context_en", F.lit("")).alias("title"), F.col("content_en").alias("body"))
    return db.transcript_texts(st, "document_id")


@query("j26_stored_or_computed", SAID + """, doc AS (SELECT DISTINCT document_id FROM sd), h AS (SELECT document_id, h1_en, min(sequence) AS q FROM sd WHERE h1_en <> '' GROUP BY document_id, h1_en), c AS (SELECT document_id, to_json(list(struct_pack(q := q, h1_en := h1_en) ORDER BY q)) AS j FROM h GROUP BY document_id)
    SELECT document_id, CASE WHEN document_id % 3 = 0 THEN '[]' ELSE CAST(j AS VARCHAR) END AS sections, CASE WHEN document_id % 3 = 0 THEN 'stored' ELSE 'computed' END AS source FROM doc LEFT JOIN c USING (document_id) WHERE document_id % 3 = 0 OR j IS NOT NULL""")  # fmt: skip
def stored(s, d):
    """A third of the documents have a public summary, a third one that isn't public."""
    st = _said(s, d, "h1_en")
    docs = st.select("document_id").distinct()
    k = F.col("document_id") % 3
    summaries = docs.filter(k < 2).select("document_id", F.lit("[]").alias("json"), (k == 0).alias("public"))
    found = st.filter("h1_en <> ''").groupBy("document_id", "h1_en").agg(F.min("sequence").alias("q"))
    return db.stored_or(found, summaries, "document_id", ["q", "h1_en"])


@query("h1_p23_search_docs", MORE + """, lm AS (SELECT politician_id, party_id, riding_id, end_date, row_number() OVER (PARTITION BY politician_id ORDER BY start_date DESC NULLS LAST, id DESC) AS rn FROM em)
    SELECT CAST(pol.id AS VARCHAR) AS id, 'mp' AS kind, CAST(json_merge_patch('{}', json_object('politician', name, 'party', party.short_name_en, 'url', '/politicians/' || pol.slug || '/', 'boosted', name || ' ' || party.short_name_en)) AS VARCHAR) AS json FROM pol JOIN lm ON lm.politician_id = pol.id AND rn = 1 JOIN party ON party.id = lm.party_id
    UNION ALL SELECT CAST(bill.id AS VARCHAR), 'bill', CAST(json_merge_patch('{}', json_object('number', number, 'url', '/bills/' || session || '/' || number || '/', 'session', session, 'date', CAST(introduced AS VARCHAR) || 'T12:00:00Z', 'boosted', 'Bill ' || number)) AS VARCHAR) FROM bill
    UNION ALL SELECT CAST(id AS VARCHAR), 'debate', CAST(json_merge_patch('{}', json_object('who_hocid', who_hocid, 'topic', NULLIF(h2_en, ''), 'date', strftime(time, '%Y-%m-%dT%H:%M:%SZ'), 'politician', NULLIF(who_en, ''))) AS VARCHAR) FROM st WHERE feed <> 'live_captions'""")  # fmt: skip
def search_docs(s, d):
    """Search documents of people who were elected, bills and statements; what is null is left out."""
    def mps():
        p = table(s, d, "party").select(F.col("id").alias("party_id"), F.col("short_name_en").alias("party"))
        last = members(s, d).groupBy(F.col("politician_id").alias("id")).agg(F.max(F.struct("start_date", F.col("id").alias("i"), "party_id"))["party_id"].alias("party_id"))
        return people(s, d).join(last, "id").join(F.broadcast(p), "party_id")  # fixed, 7 rows

    none = lambda c: F.nullif(F.col(c), F.lit(""))
    mp = {"id": F.col("id"), "politician": F.col("name"), "party": F.col("party"), "url": tx.person_url(F.col("slug"), F.col("id")), "boosted": F.concat_ws(" ", "name", "party")}
    bill = {"id": F.col("id"), "number": F.col("number"), "url": tx.bill_url(F.col("session"), F.col("number")), "session": F.col("session"),
            "date": F.concat(F.col("introduced").cast("string"), F.lit("T12:00:00Z")), "boosted": F.concat(F.lit("Bill "), "number")}
    said = {"id": F.col("id"), "who_hocid": F.col("who_hocid"), "topic": none("h2_en"), "date": F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "politician": none("who_en")}
    return search.search_documents([
        search.Source("mp", mps, mp), search.Source("bill", lambda: bills(s, d), bill),
        search.Source("debate", lambda: statements(s, d, "who_hocid", "h2_en", "time", "who_en", "feed"), said, F.col("feed") != "live_captions"),
    ])


@query("s24_lookup_cascade", BASE + ", ask AS (SELECT DISTINCT riding_id AS code FROM em WHERE riding_id IS NOT NULL), c1 AS (SELECT riding_id AS code, min(party_id) AS p FROM em WHERE end_date IS NULL GROUP BY riding_id), c2 AS (SELECT riding_id AS code, max(party_id) AS p FROM em GROUP BY riding_id) SELECT ask.code, COALESCE(c1.p, c2.p) AS found, CASE WHEN c1.p IS NOT NULL THEN 'cache' ELSE 'outside' END AS source FROM ask LEFT JOIN c1 ON c1.code = ask.code LEFT JOIN c2 ON c2.code = ask.code")
def cascade(s, d):
    """A cache first, another table for what it lacks; what is found there goes into the cache."""
    from quorumlake.operators.joins import cached_lookup

    m = members(s, d).filter("riding_id is not null")
    cache = m.filter("end_date is null").groupBy(F.col("riding_id").alias("code")).agg(F.min("party_id").alias("found")).filter("found is not null")
    outside = m.groupBy(F.col("riding_id").alias("code")).agg(F.max("party_id").alias("found"))
    return cached_lookup(m.select(F.col("riding_id").alias("code")).distinct(), cache, outside, "code", "found")[0]


@query("a36_meetings", BASE + """, x AS (SELECT session_id, number AS o, result = 'Y' AS s, 'Item ' || CAST(number AS VARCHAR) AS n FROM vq), g AS (SELECT session_id, list(n ORDER BY o) FILTER (WHERE s) AS l FROM x GROUP BY session_id)
    SELECT session_id, CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) = 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[:-2], ', ') || ',  and ' || l[-1] END AS summary FROM g""")  # fmt: skip
def meetings(s, d):
    """Votes of a session as a meeting's activities, those agreed to as its studies."""
    q = questions(s, d).select("session_id", F.concat(F.lit("Item "), F.col("number").cast("string")).alias("n"), (F.col("result") == "Y").alias("s"), "number")
    return mk.meeting_summary(q, "session_id", "n", "s", "number")


@query("f25_links", BASE + """SELECT id, 'See <a class="x" data-HoCid="' || CAST(politician_id AS VARCHAR) || '"' || CASE WHEN politician_id % 2 = 0 THEN ' href="/p/' || CAST(politician_id AS VARCHAR) || '/"' ELSE '' END || '>them</a>.' AS body FROM em WHERE politician_id IS NOT NULL""")
def links(s, d):
    """Links to people of even numbers get an address, others have none."""
    m = members(s, d).filter("politician_id is not null").select("id", F.concat(F.lit('See <a class="x" data-HoCid="'), F.col("politician_id").cast("string"), F.lit('">them</a>.')).alias("body"))
    targets = people(s, d).filter("id % 2 = 0").select(F.col("id").alias("hocid"), F.concat(F.lit("/p/"), F.col("id").cast("string"), F.lit("/")).alias("url"))
    return mk.linked(m, "id", "body", targets).select("id", "body")


@query("f27_opaque_urls", BASE + "SELECT id, 'u' || substr(sha1('/p/' || slug), 1, 12) AS token, '/p/' || slug AS url, '[' || name || '](u' || substr(sha1('/p/' || slug), 1, 12) || ')' AS body FROM pol")
def opaque(s, d):
    """Addresses as tokens, and the table that leads back."""
    p = people(s, d).select("id", F.concat(F.lit("["), "name", F.lit("](/p/"), "slug", F.lit(")")).alias("body"))
    got, known = mk.opaque_urls(p, "id", "body")
    token = F.regexp_extract("body", r"\]\(([^)]+)\)", 1)
    return got.withColumn("token", token).join(known, "token").select("id", "token", "url", "body")


@query("f38_committee_slugs", BASE + r"SELECT id, substr('committee-' || regexp_replace(lower(translate(n, 'àâäéèêëîïôöùûüçÀÂÉÈÊÎÔÛÇ', 'aaaeeeeiioouuucAAEEEIOUC')), '[^a-z0-9]+', '-', 'g'), 1, 46) AS slug, id % 2 = 0 AS refused FROM (SELECT id, 'The Committee on ' || name || ' 2' AS n FROM pol)")
def committee_slugs(s, d):
    """Slugs of committees named after people; those of even numbers are taken."""
    p = people(s, d).select("id", mk.committee_slug(F.concat(F.lit("The Committee on "), "name", F.lit(" 2")), F.lit("committee")).alias("slug"))
    return mk.new_slugs(p, "slug", p.filter("id % 2 = 0")).select("id", "slug", "refused")


@query("f19_q9_highlight", r"SELECT doc_id, replace(replace(replace(replace(replace(regexp_replace(text, '(?i)\b(petition\w*)', '~hl~\1~/hl~', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '~hl~', '<em>'), '~/hl~', '</em>') AS marked FROM documents WHERE lower(text) LIKE '%petition%'")
def highlight(s, d):
    docs = table(s, d, "documents").filter(F.lower("text").contains("petition"))
    return docs.select("doc_id", tx.autohighlight(tx.marked(F.col("text"), "petition")).alias("marked"))


@query("w13_carry_forward", SAID + """, g AS (SELECT id, document_id, sequence, NULLIF(who_context_en, '') AS c, CASE WHEN sequence % 7 = 0 THEN h2_en END AS h, CASE WHEN wordcount > 60 THEN wordcount END AS w FROM sd),
    k AS (SELECT *, count(c) OVER o AS gc, count(h) OVER o AS gh, count(w) OVER o AS gw FROM g WINDOW o AS (PARTITION BY document_id ORDER BY sequence))
    SELECT id, max(c) OVER (PARTITION BY document_id, gc) AS context, max(h) OVER (PARTITION BY document_id, gh) AS heading, max(w) OVER (PARTITION BY document_id, gw) AS words FROM k""")  # fmt: skip
def carry(s, d):
    """Three kinds of state carried to the statements after: the last context, a heading given now and then, the last long count."""
    from quorumlake.operators.runs import fill_all

    st = _said(s, d, "who_context_en", "h2_en", "wordcount").withColumns({"c": F.nullif("who_context_en", F.lit("")), "h": F.when(F.col("sequence") % 7 == 0, F.col("h2_en")), "w": F.when(F.col("wordcount") > 60, F.col("wordcount"))})
    got = fill_all(st.withColumn("chunk", F.floor(F.col("sequence") / 50)), ["document_id"], ["sequence"], {"c": "context", "h": "heading", "w": "words"}, "chunk")
    return got.select("id", "context", "heading", "words")


@query("k9_feeds", BASE + """, a AS (SELECT 'person' AS feed, CAST(politician_id AS VARCHAR) AS o, id AS item, time AS at, row_number() OVER (PARTITION BY politician_id ORDER BY time DESC NULLS LAST, id DESC) AS rn, 12 AS most FROM st WHERE politician_id IS NOT NULL AND NOT procedural
      UNION ALL SELECT 'bill', CAST(bill_id AS VARCHAR), id, CAST(date AS TIMESTAMP), row_number() OVER (PARTITION BY bill_id ORDER BY date DESC NULLS LAST, id DESC), 3 FROM vq WHERE bill_id IS NOT NULL
      UNION ALL SELECT 'votes', session_id, id, CAST(date AS TIMESTAMP), row_number() OVER (PARTITION BY session_id ORDER BY date DESC NULLS LAST, id DESC), 10 FROM vq)
    SELECT feed, o AS owner, item, a."at" FROM a WHERE rn <= most""")  # fmt: skip
def feeds(s, d):
    """The newest statements of every person, votes on every bill, votes of every session, each with its number of items."""
    from quorumlake.operators import ranking

    st = statements(s, d, "politician_id", "procedural", "time").filter("politician_id is not null and not procedural")
    q = questions(s, d)
    at = F.col("date").cast("timestamp_ntz")
    of = lambda df, feed, key, time, n: ranking.top_n(df.select(F.lit(feed).alias("feed"), F.col(key).cast("string").alias("owner"), F.col("id").alias("item"), time.alias("at")), ["owner"], n, F.desc_nulls_last("at"), F.desc("item"))
    return of(st, "person", "politician_id", F.col("time"), 12).unionByName(of(q.filter("bill_id is not null"), "bill", "bill_id", at, 3)).unionByName(of(q, "votes", "session_id", at, 10))


@query("flt_p28_home", MORE + """SELECT * FROM (SELECT 'debate' AS kind, CAST(id AS VARCHAR) AS key, date AS day FROM deb ORDER BY date DESC, id DESC LIMIT 1) a UNION ALL SELECT * FROM (SELECT 'bill', number, status_date FROM bill ORDER BY status_date DESC, number LIMIT 6) b
    UNION ALL SELECT * FROM (SELECT 'vote', CAST(id AS VARCHAR), date FROM vq WHERE session_id = (SELECT max(session_id) FROM vq) ORDER BY date DESC, number DESC, id LIMIT 6) c""")  # fmt: skip
def home(s, d):
    """The latest sitting, the bills debated last, the votes of the current session."""
    from quorumlake.plans.lists import debates

    of = lambda df, kind, key, day: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(day).alias("day"))
    q = questions(s, d)
    current = q.agg(F.max("session_id").alias("session_id"))
    now = q.join(F.broadcast(current), "session_id", "left_semi").orderBy(F.desc("date"), F.desc("number"), "id").limit(6)  # one row
    latest = debates(s, d).orderBy(F.desc("date"), F.desc("id")).limit(1)
    recent = bills(s, d).orderBy(F.desc("status_date"), "number").limit(6)
    return of(latest, "debate", "id", "date").unionByName(of(recent, "bill", "number", "status_date")).unionByName(of(now, "vote", "id", "date"))


QUERIES, ORACLE = REGISTRY.queries, REGISTRY.sql
