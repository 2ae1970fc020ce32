"""Queries over statements and documents: debates, language models, search, text functions (ids A2-A36, F, D, Q, R, W4-W12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.catalog import once, table
from quorumlake.functions import dates as dt
from quorumlake.functions import text as tx
from quorumlake.operators import debates as db
from quorumlake.operators import language, ranking, search
from quorumlake.plans import records
from quorumlake.plans.records import BASE, people, questions, statements
from quorumlake.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


def _said(s: SparkSession, d: str, *cols: str) -> DataFrame:
    """Statements with an order: captions have none of their own."""
    return statements(s, d, "document_id", "sequence", "feed", *cols).filter("feed <> 'live_captions'")


SAID = BASE + ", sd AS (SELECT * FROM st WHERE feed <> 'live_captions') "


@query("a2_words_per_heading", SAID + "SELECT document_id, h2_en, CAST(sum(wordcount) AS BIGINT) AS words FROM sd WHERE NOT procedural GROUP BY document_id, h2_en HAVING sum(wordcount) > 150")
def words_per_heading(s, d):
    return _said(s, d, "h2_en", "wordcount", "procedural").filter("not procedural").groupBy("document_id", "h2_en").agg(F.sum("wordcount").alias("words")).filter("words > 150")


@query(
    "a3_g10_stale_summaries",
    SAID + """, a AS (SELECT document_id, h1_en, CAST(sum(wordcount) AS BIGINT) AS words, max(time) AS latest, count(*) AS n FROM sd WHERE NOT procedural GROUP BY document_id, h1_en HAVING sum(wordcount) >= 300),
    old AS (SELECT document_id, h1_en, count(*) AS n_old FROM sd WHERE NOT procedural AND time < TIMESTAMP '2017-06-01 00:00:00' GROUP BY document_id, h1_en)
    SELECT a.document_id, a.h1_en, a.words, a.latest, a.n FROM a LEFT JOIN old ON old.document_id = a.document_id AND old.h1_en = a.h1_en WHERE old.n_old IS NULL OR a.n - old.n_old >= 10""",
)
def stale(s, d):
    """Groups with enough words that no summary covers, or that grew by ten statements since."""
    st = _said(s, d, "h1_en", "wordcount", "procedural", "time").filter("not procedural")
    a = st.groupBy("document_id", "h1_en").agg(F.sum("wordcount").alias("words"), F.max("time").alias("latest"), F.count("*").alias("n")).filter("words >= 300")
    old = st.filter(F.col("time") < F.lit("2017-06-01").cast("timestamp_ntz")).groupBy("document_id", "h1_en").agg(F.count("*").alias("n_old"))
    return a.join(old, ["document_id", "h1_en"], "left").filter("n_old is null or n - n_old >= 10").select("document_id", "h1_en", "words", "latest", "n")


@query("a5_highest_number", BASE + "SELECT max(TRY_CAST(regexp_extract(session_id, '-(.*)$', 1) AS INTEGER)) AS top FROM vq")
def highest(s, d):
    return questions(s, d).agg(F.max(F.expr("try_cast(regexp_extract(session_id, '-(.*)$', 1) as int)")).alias("top"))


@query(
    "a20_w9_long_speeches",
    SAID + """, a AS (SELECT *, lag(sequence) OVER (PARTITION BY document_id ORDER BY sequence) AS ps, lag(politician_id) OVER (PARTITION BY document_id ORDER BY sequence) AS pm,
      row_number() OVER (PARTITION BY document_id ORDER BY sequence) AS rn FROM sd WHERE NOT procedural),
    b AS (SELECT *, sum(CASE WHEN rn > 1 AND pm IS NOT DISTINCT FROM politician_id AND sequence - ps BETWEEN 1 AND 3 THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY sequence) AS run FROM a),
    c AS (SELECT document_id, run, min(politician_id) AS member, min(sequence) AS first_seq, max(sequence) AS last_seq, CAST(sum(wordcount) AS BIGINT) AS words FROM b GROUP BY document_id, run),
    e AS (SELECT *, max(run) OVER (PARTITION BY document_id) AS last_run FROM c)
    SELECT document_id, member, first_seq, last_seq, words FROM e WHERE run < last_run AND words > 120""",
)
def long_speeches(s, d):
    st = _said(s, d, "politician_id", "wordcount", "procedural").filter("not procedural").withColumnRenamed("politician_id", "member")
    return db.long_speeches(st.select("document_id", "sequence", "member", "wordcount"), least=120)


@query(
    "a22_p29_speakers",
    SAID + r"""SELECT document_id, who, person, first_seq, slug, politician, minister, description, CASE WHEN minister OR NOT (politician OR starts_with(who, 'Clerk ')) THEN 'outside' WHEN politician AND NOT minister THEN 'member' ELSE 'clerk' END AS side FROM (
    WITH f AS (SELECT sd.*, pol.name, COALESCE(pol.name, trim(regexp_replace(regexp_replace(who_en, '\s*\(.+\)\s*', '', 'g'), '^\s*\S+\s+', ''))) AS who, row_number() OVER (PARTITION BY document_id, who_hocid ORDER BY sequence, sd.id) AS n FROM sd LEFT JOIN pol ON pol.id = sd.politician_id WHERE who_hocid IS NOT NULL),
    g AS (SELECT *, row_number() OVER (PARTITION BY document_id, who ORDER BY sequence, id) AS m FROM f WHERE n = 1)
    SELECT document_id, who, who_hocid AS person, sequence AS first_seq, slug, name IS NOT NULL AS politician, name IS NOT NULL AND COALESCE(regexp_matches(who_context_en, 'Minist(er|re) '), false) AS minister, NULLIF(who_context_en, '') AS description FROM g WHERE m = 1)""",
)
def speakers(s, d):
    who = people(s, d).select(F.col("id").alias("politician_id"), "name")
    st = _said(s, d, "who_en", "who_hocid", "who_context_en", "slug", "politician_id").join(who, "politician_id", "left")
    got = db.speakers(st.withColumnsRenamed({"who_en": "who", "who_context_en": "context"}))
    side = lambda df, n: df.withColumn("side", F.lit(n))
    clerks = got.filter("not politician").filter(F.col("who").startswith("Clerk "))
    return side(db.outside_speakers(got), "outside").unionByName(side(db.member_speakers(got), "member")).unionByName(side(clerks, "clerk"))


@query(
    "a26_heading_runs",
    SAID + """, a AS (SELECT *, lag(h1_en) OVER (PARTITION BY document_id ORDER BY sequence) AS p1, lag(h2_en) OVER (PARTITION BY document_id ORDER BY sequence) AS p2,
      row_number() OVER (PARTITION BY document_id ORDER BY sequence) AS rn FROM sd),
    b AS (SELECT *, sum(CASE WHEN rn = 1 OR p1 IS DISTINCT FROM h1_en OR p2 IS DISTINCT FROM h2_en THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY sequence) AS run FROM a)
    SELECT document_id, CAST(run AS BIGINT) AS run, min(h1_en) AS h1_en, min(h2_en) AS h2_en, count(*) AS statements, CAST(sum(CASE WHEN procedural THEN 0 ELSE wordcount END) AS BIGINT) AS words
    FROM b GROUP BY document_id, run HAVING sum(CASE WHEN procedural THEN 0 ELSE wordcount END) >= 200""",
)
def heading_runs(s, d):
    return db.heading_runs(_said(s, d, "h1_en", "h2_en", "wordcount", "procedural"), ["h1_en", "h2_en"], 200)


_SPECIAL = "('oral questions', 'oral question period', 'adjournment proceedings', 'statements by members')"


@query(
    "a19_sections",
    SAID + f""", a AS (SELECT *, COALESCE(h1_en, '') AS h1, COALESCE(h2_en, '') AS h2, min(sequence) OVER (PARTITION BY document_id) AS f FROM sd),
    k AS (SELECT *, CASE WHEN lower(h1) IN {_SPECIAL} THEN '1|' || h1 WHEN contains('Petitions', h2) THEN '2|' || h1 || '|' || h2 ELSE '3|' || h1 || '|' || h2 END AS key
      FROM a WHERE sequence = f OR NOT starts_with(lower(h2), 'questions ')),
    l AS (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY document_id ORDER BY sequence) = key THEN 0 ELSE 1 END AS new FROM k),
    n AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY sequence) AS run FROM l),
    r AS (SELECT document_id, run, min(sequence) AS s0, max(sequence) AS s1, arg_min(time, sequence) AS t0, arg_max(time, sequence) AS t1, arg_min(slug, sequence) AS slug,
      arg_min(h1, sequence) AS h1, arg_min(h2, sequence) AS h2, sum(CASE WHEN procedural THEN 0 ELSE wordcount END) AS words, count(*) AS statements, max(wordcount) AS longest,
      CASE WHEN min(lower(h1)) = max(lower(h1)) AND min(h1) <> '' THEN arg_min(h1, sequence) END AS o1, CASE WHEN min(lower(h2)) = max(lower(h2)) AND min(h2) <> '' THEN arg_min(h2, sequence) END AS o2
      FROM n GROUP BY document_id, run),
    q AS (SELECT *, lower(h1) || '|' || lower(h2) AS same, floor((date_diff('second', t0, t1) % 86400) / 60.0) AS minutes FROM r WHERE words <> 0),
    g AS (SELECT *, CASE WHEN s0 - lag(s1) OVER w > 5 AND t0 <> lag(t1) OVER w THEN 1 ELSE 0 END AS apart FROM q WINDOW w AS (PARTITION BY document_id, same ORDER BY run))
    SELECT document_id, min(s0) AS first_seq, arg_min(slug, run) AS slug, arg_min(h1, run) AS h1, arg_min(h2, run) AS h2,
      COALESCE(CASE lower(arg_min(h1, run)) WHEN 'oral questions' THEN 'Question Period' WHEN 'oral question period' THEN 'Question Period' WHEN 'adjournment proceedings' THEN 'Adjournment Debates' WHEN 'statements by members' THEN 'Statements by Members' END,
        CASE WHEN min(lower(o2)) = max(lower(o2)) AND count(o2) = count(*) THEN arg_min(o2, run) END, CASE WHEN min(lower(o1)) = max(lower(o1)) AND count(o1) = count(*) THEN arg_min(o1, run) END) AS display_heading,
      CAST(sum(words) AS BIGINT) AS words, CAST(sum(minutes) AS INTEGER) AS minutes, CAST(sum(statements) AS BIGINT) AS statements, max(longest) AS longest, CAST(1 + sum(apart) AS INTEGER) AS segments
    FROM g GROUP BY document_id, same HAVING sum(words) >= 500 OR max(longest) >= 300""",
)
def a19_sections(s, d):
    """The tables have neither third headings nor bills."""
    st = _said(s, d, "time", "slug", "h1_en", "h2_en", "wordcount", "procedural")
    return db.sections(_sectioned(st)).drop("h3", "bill", "stage")


def _sectioned(st: DataFrame) -> DataFrame:
    return st.select(
        "document_id", "sequence", "time", "slug", F.col("h1_en").alias("h1"), F.col("h2_en").alias("h2"), F.lit("").alias("h3"), F.lit(None).cast("string").alias("bill"),
        F.lit("").alias("stage"), "wordcount", "procedural",
    )


@query(
    "a24_activity",
    SAID + """, a AS (SELECT document_id, politician_id, h2_en AS topic, id, wordcount, row_number() OVER (PARTITION BY document_id, politician_id, h2_en ORDER BY wordcount DESC, id) AS rn,
      sum(wordcount) OVER (PARTITION BY document_id, politician_id, h2_en) AS w FROM sd WHERE politician_id IS NOT NULL AND NOT procedural)
    SELECT document_id, politician_id, topic, CAST(w AS BIGINT) AS words, id AS longest FROM a WHERE rn = 1 AND w >= 80""",
)
def activity(s, d):
    return db.activity(_said(s, d, "politician_id", "h2_en", "wordcount", "procedural").withColumnRenamed("h2_en", "topic"), 80)


@query("w10_run_minutes", SAID + """, a AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(h1_en) OVER w IS NOT DISTINCT FROM h1_en THEN 0 ELSE 1 END AS new FROM sd WINDOW w AS (PARTITION BY document_id ORDER BY sequence)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY sequence) AS run FROM a)
    SELECT document_id, CAST(run AS BIGINT) AS run, any_value(h1_en) AS heading, CAST(floor((date_diff('second', arg_min(time, sequence), arg_max(time, sequence)) % 86400) / 60.0) AS BIGINT) AS minutes FROM r GROUP BY document_id, run""")  # fmt: skip
def run_minutes(s, d):
    return db.run_minutes(_said(s, d, "h1_en", "time"), "h1_en")


_PLAIN = f"translate(who_en, '{tx.ACCENTED}', '{tx.PLAIN}')"
_SLUG = f"trim(regexp_replace(lower({_PLAIN}), '[^a-z]+', ' ', 'g'))"


@query(
    "w4_f2_statement_slugs",
    SAID + f""", a AS (SELECT id, document_id, sequence, trim(substr({_SLUG}, 1, 50)) AS b FROM sd), c AS (SELECT *, CASE WHEN b = '' THEN 'procedural' ELSE regexp_replace(b, ' +', '-', 'g') END AS base FROM a)
    SELECT id, base || '-' || CAST(row_number() OVER (PARTITION BY document_id, base ORDER BY sequence, id) AS VARCHAR) AS slug_no FROM c""",
)
def slugs(s, d):
    return db.statement_slugs(_said(s, d, "who_en"), F.col("who_en")).select("id", "slug_no")


@query(
    "w5_timed_slugs",
    SAID + f""", a AS (SELECT id, document_id, sequence, time, trim(substr({_SLUG}, 1, 50)) AS b FROM sd),
    c AS (SELECT *, (CASE WHEN b = '' THEN 'procedural' ELSE regexp_replace(b, ' +', '-', 'g') END) || '-' || strftime(time, '%H%M') AS base FROM a),
    e AS (SELECT *, row_number() OVER (PARTITION BY document_id, base ORDER BY sequence, id) AS rn FROM c)
    SELECT id, CASE WHEN rn > 1 THEN base || '-' || CAST(rn AS VARCHAR) ELSE base END AS slug_time FROM e""",
)
def timed(s, d):
    return db.timed_slugs(_said(s, d, "who_en", "time"), F.col("who_en")).select("id", "slug_time")


# --- language models -------------------------------------------------------------------------------------------------------

_TOK = r"""tk AS (SELECT doc_id, source, regexp_split_to_array(regexp_replace(lower(text), '[^\s\p{L}\p{N}_''’—-]', '', 'g'), '[\s—]+') AS w FROM documents WHERE lower(substr(trim(lang), 1, 2)) = 'en')"""
_UNI = "WITH " + _TOK + ", g AS (SELECT doc_id, source, unnest(w) AS gram FROM tk), "


def _english(s, d):
    """Documents whose language tag is English, however it is written; those without a tag are of no language."""
    return table(s, d, "documents").filter("lower(substr(trim(lang), 1, 2)) = 'en'").select("doc_id", "source", "text")


@query("a12_unigrams", _UNI + """c AS (SELECT gram, count(*) AS cnt FROM g WHERE length(gram) > 2 AND gram NOT LIKE '%/%' GROUP BY gram), t AS (SELECT sum(cnt) AS n FROM c)
    SELECT gram, cnt, CAST(cnt AS DOUBLE) / (SELECT n FROM t) AS p FROM c WHERE cnt >= 5""")  # fmt: skip
def unigrams(s, d):
    return language.frequencies(_english(s, d), [], "text", 1, min_count=5)


@query("a12_w12_bigrams", "WITH " + _TOK + """, i AS (SELECT w, unnest(range(1, len(w))) AS i FROM tk), g AS (SELECT w[i] || ' ' || w[i + 1] AS gram FROM i),
    c AS (SELECT gram, count(*) AS cnt FROM g WHERE length(gram) > 2 AND gram NOT LIKE '%/%' GROUP BY gram), t AS (SELECT sum(cnt) AS n FROM c)
    SELECT gram, cnt, CAST(cnt AS DOUBLE) / (SELECT n FROM t) AS p FROM c WHERE cnt >= 5""")  # fmt: skip
def bigrams(s, d):
    return language.frequencies(_english(s, d), [], "text", 2, min_count=5)


STOP = language.STOP_WORDS
_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP)
_KEY = _UNI + """c AS (SELECT source, gram, count(*) AS cnt FROM g WHERE length(gram) > 2 AND gram NOT LIKE '%/%' AND source IS NOT NULL GROUP BY source, gram),
t AS (SELECT source, sum(cnt) AS n FROM c GROUP BY source), fg AS (SELECT c.source, gram, cnt, CAST(cnt AS DOUBLE) / n AS p FROM c JOIN t ON t.source = c.source),
bc AS (SELECT gram, count(*) AS cnt FROM g WHERE length(gram) > 2 AND gram NOT LIKE '%/%' GROUP BY gram), bt AS (SELECT sum(cnt) AS n FROM bc),
bg AS (SELECT gram, CAST(cnt AS DOUBLE) / (SELECT n FROM bt) AS p FROM bc WHERE cnt >= 5),
k AS (SELECT fg.source, fg.gram, fg.p - COALESCE(bg.p, 0) AS score FROM fg LEFT JOIN bg ON bg.gram = fg.gram
  WHERE fg.gram NOT IN (""" + _STOPS + """) AND (bg.p IS NULL OR fg.p / bg.p >= 2)) """


def _key(s, d):
    counts = language.counts(_english(s, d), ["source"], "text", 1)
    return language.keyness(language.shares(counts.filter("source is not null"), ["source"]), language.shares(counts, [], 5), STOP)


@query("a14_a15_keyness", _KEY + "SELECT source, gram, round(score, 9) AS score FROM k")
def keyness(s, d):
    return _key(s, d).select("source", "gram", F.round("score", 9).alias("score"))


@query("a18_t6_top_words", _KEY + "SELECT source, gram FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, gram) AS rn FROM k) WHERE rn <= 3")
def top_words(s, d):
    return ranking.top_n(_key(s, d).withColumn("score", F.round("score", 9)), ["source"], 3, F.desc("score"), F.asc("gram")).select("source", "gram")


def _top_sql(n: int, least: int) -> str:
    grams = "g1" if n == 1 else f"i{n}"
    make = "SELECT doc_id, source, unnest(w) AS gram FROM tk" if n == 1 else (
        f"SELECT source, {' || chr(32) || '.join(f'w[i + {k}]' if k else 'w[i]' for k in range(n))} AS gram FROM (SELECT source, w, unnest(range(1, len(w) - {n - 2})) AS i FROM tk)"
    )
    return f"""{grams} AS (SELECT source, gram FROM ({make}) WHERE length(gram) > 2 AND gram NOT LIKE '%/%'),
    c{n} AS (SELECT source, gram, count(*) AS cnt FROM {grams} WHERE source IN (SELECT source FROM ok) GROUP BY source, gram),
    t{n} AS (SELECT source, sum(cnt) AS n FROM c{n} GROUP BY source), bc{n} AS (SELECT gram, count(*) AS cnt FROM {grams} GROUP BY gram), bt{n} AS (SELECT sum(cnt) AS n FROM bc{n}),
    k{n} AS (SELECT c.source, c.gram, round(CAST(c.cnt AS DOUBLE) / t.n - COALESCE(CAST(b.cnt AS DOUBLE) / bt.n, 0), 12) AS score, CAST(c.cnt AS DOUBLE) / t.n AS p, CAST(b.cnt AS DOUBLE) / bt.n AS bg
      FROM c{n} c JOIN t{n} t ON t.source = c.source CROSS JOIN bt{n} bt LEFT JOIN bc{n} b ON b.gram = c.gram AND b.cnt >= {least}),
    top{n} AS (SELECT source, gram, {n} AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, gram) AS rn FROM k{n}
      WHERE gram NOT IN ({_STOPS}) AND (bg IS NULL OR p / bg >= 2)) WHERE rn <= 50)"""


@query(
    "a17_keywords",
    "WITH RECURSIVE " + _TOK + r""", ok AS (SELECT source FROM documents WHERE lower(substr(trim(lang), 1, 2)) = 'en' AND source IS NOT NULL GROUP BY source
      HAVING sum(CASE WHEN trim(regexp_replace(text, '[\s ]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[\s ]+', ' ', 'g')), ' ')) END) >= 1000), """
    + ", ".join(_top_sql(n, 5 if n < 3 else 3) for n in (3, 2, 1))
    + f""", al AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, score DESC, gram) AS i FROM (SELECT * FROM top3 UNION ALL SELECT * FROM top2 UNION ALL SELECT * FROM top1)),
    f AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS i, [{_STOPS}] AS seen, false AS ok FROM al UNION ALL
      SELECT f.source, f.i + 1, CASE WHEN NOT list_contains(f.seen, string_split(al.gram, ' ')[1]) AND NOT list_contains(f.seen, string_split(al.gram, ' ')[-1]) THEN list_concat(f.seen, string_split(al.gram, ' ')) ELSE f.seen END,
        NOT list_contains(f.seen, string_split(al.gram, ' ')[1]) AND NOT list_contains(f.seen, string_split(al.gram, ' ')[-1]) FROM f JOIN al ON al.source = f.source AND al.i = f.i + 1)
    SELECT al.source, al.gram, CAST(al.n AS INTEGER) AS n, al.score * 1000 AS score FROM f JOIN al ON al.source = f.source AND al.i = f.i WHERE f.ok""",
)
def a17_keywords(s, d):
    """Top fifty n-grams of each length per source, then the greedy choice; sources with too few words have none."""
    docs = _english(s, d)
    enough = docs.filter("source is not null").groupBy("source").agg(F.sum(tx.word_count(F.col("text"))).alias("n")).filter("n >= 1000").select("source")
    top = None
    for n in (3, 2, 1):
        # The texts are cut once per length: the background comes from the counts per source.
        counts = language.counts(docs, ["source"], "text", n)
        model = language.shares(counts.join(F.broadcast(enough), "source"), ["source"])  # one row per source
        scored = language.keyness(model, language.shares(counts, [], 5 if n < 3 else 3), STOP).withColumn("score", F.round("score", 12))
        best = ranking.top_n(scored, ["source"], 50, F.desc("score"), F.asc("gram")).select("source", "gram", F.lit(n).alias("n"), "score")
        top = best if top is None else top.unionByName(best)
    return language.choose_keywords(top, ["source"], STOP).withColumn("score", F.col("score") * 1000)


@query("a16_word_source", _UNI + "c AS (SELECT gram, source, count(*) AS n FROM g WHERE length(gram) > 4 AND source IS NOT NULL GROUP BY gram, source) SELECT gram, source FROM (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY n DESC, source) AS rn FROM c) WHERE rn = 1")
def word_source(s, d):
    """The attribute that uses each word most."""
    g = _english(s, d).filter("source is not null").select("source", F.explode(tx.words_of(F.col("text"))).alias("gram")).filter("length(gram) > 4")
    return ranking.top_n(g.groupBy("gram", "source").agg(F.count("*").alias("n")), ["gram"], 1, F.desc("n"), F.asc("source")).select("gram", "source")


# --- search ----------------------------------------------------------------------------------------------------------------

_TERMS = f"""WITH tk AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}'), '[''’]s\\b', '', 'g'), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
pst AS (SELECT term, doc_id, count(*) AS tf FROM tk WHERE length(term) >= 1 GROUP BY term, doc_id) """


@query("s23_q4_postings", _TERMS + "SELECT term, doc_id, tf FROM pst")
def postings(s, d):
    return search.postings(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text")


_BM = _TERMS + """, h AS (SELECT * FROM pst WHERE term IN ('carbon', 'storage', 'petition')), df AS (SELECT term, count(*) AS df FROM h GROUP BY term), nn AS (SELECT count(*) AS n FROM documents),
sc AS (SELECT h.doc_id, sum(ln(1 + ((SELECT n FROM nn) - df.df + 0.5) / (df.df + 0.5)) * h.tf * 2.2 / (h.tf + 1.2)) AS score, count(*) AS hits FROM h JOIN df ON df.term = h.term GROUP BY h.doc_id) """


def _hits(s, d, every=False):
    docs = table(s, d, "documents").select("doc_id", "text")
    return search.ranked(search.postings(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n")), ["carbon", "storage", "petition"], "doc_id", all_terms=every)


@query("q4_q7_ranked", _BM + "SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY round(score, 6) DESC, doc_id LIMIT 15 OFFSET 15")
def ranked(s, d):
    return _hits(s, d).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").offset(15).limit(15)


@query("q5_all_terms", _BM + "SELECT doc_id, round(score, 6) AS score FROM sc WHERE hits = 3")
def all_terms(s, d):
    return _hits(s, d, True).select("doc_id", F.round("score", 6).alias("score"))


@query("q1_q2_d5_filtered", "SELECT doc_id, published_on FROM documents WHERE source = 'petitions' AND doc_kind = 'report' AND published_on >= DATE '2016-11-01' AND published_on <= DATE '2017-04-01'")
def filtered(s, d):
    """The query string's filters and its date range; the range reaches 61 seconds into the day after."""
    asked = search.parse('Source: "petitions"  Kind: "report" Date: "2016-11 to 2017-3"', {"Source", "Kind", "Date"})
    df = table(s, d, "documents").select("doc_id", "source", "doc_kind", "published_on")
    df = df.filter((F.col("source") == asked.filters["Source"]) & (F.col("doc_kind") == asked.filters["Kind"]))
    return search.within_dates(df, "published_on", asked.filters["Date"]).select("doc_id", "published_on")


@query("a27_q8_facets", "SELECT 'source' AS field, source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'doc_kind', doc_kind, count(*) FROM documents WHERE doc_kind IS NOT NULL GROUP BY doc_kind")
def facets(s, d):
    return search.facets(table(s, d, "documents"), ["source", "lang", "doc_kind"])


@query("a28_year_facets", "SELECT CAST(year(published_on) AS INTEGER) AS y, count(*) AS n FROM documents WHERE published_on >= DATE '1994-01-01' GROUP BY year(published_on)")
def year_facets(s, d):
    return table(s, d, "documents").filter(F.col("published_on") >= "1994-01-01").groupBy(F.year("published_on").alias("y")).agg(F.count("*").alias("n"))


@query("u6_q11_search_docs", BASE + "SELECT 'politician' AS kind, id, name AS title FROM pol WHERE EXISTS (SELECT 1 FROM em WHERE em.politician_id = pol.id) UNION ALL SELECT 'vote', id, description_en FROM vq UNION ALL SELECT 'statement', id, h2_en FROM st WHERE content_fr <> ''")
def search_docs(s, d):
    m = records.members(s, d).select(F.col("politician_id").alias("id"))
    p = people(s, d).join(m, "id", "left_semi").select(F.lit("politician").alias("kind"), "id", F.col("name").alias("title"))
    v = questions(s, d).select(F.lit("vote").alias("kind"), "id", F.col("description_en").alias("title"))
    st = statements(s, d, "h2_en", "content_fr").filter("content_fr <> ''").select(F.lit("statement").alias("kind"), "id", F.col("h2_en").alias("title"))
    return p.unionByName(v).unionByName(st)


# --- text and date functions -------------------------------------------------------------------------------------------------


def _who(s, d):
    return statements(s, d, "who_en").select("id", "who_en")


@query("f1_f3_normal_names", BASE + f"SELECT id, replace(replace(trim(regexp_replace(translate(lower(regexp_replace(who_en, '^(Right Hon\\.|Hon\\.|Mr\\.|Mrs\\.|Ms\\.|Miss|Dr\\.|Mme|M\\.) +', '')), '{tx.ACCENTED}', '{tx.PLAIN}'), '[\\s\\x{{00A0}}]+', ' ', 'g')), '’', ''''), '‘', '''') AS name FROM st")
def normal_names(s, d):
    return _who(s, d).select("id", tx.normal_name(F.col("who_en")).alias("name"))


@query("f10_html_text", BASE + r"SELECT id, regexp_replace(replace(regexp_replace(replace(regexp_replace(replace(content_en, chr(10), ''), '<br ?/?>', chr(10), 'g'), '</p>', chr(10) || chr(10)), '<[^>]*>', '', 'g'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS body FROM st WHERE feed <> 'live_captions'")
def html_text(s, d):
    return statements(s, d, "content_en", "feed").filter("feed <> 'live_captions'").select("id", tx.html_text(F.col("content_en")).alias("body"))


@query("f12_f26_paragraphs", BASE + """, p AS (SELECT id, unnest(regexp_extract_all(content_en, '<p[^>]*>[^<]*</p>')) AS p FROM st WHERE feed <> 'live_captions')
    SELECT id, NULLIF(regexp_extract(p, 'data-originallang="(\\w+)"', 1), '') AS original, count(*) AS n,
    CAST(sum(CASE WHEN trim(regexp_replace(regexp_extract(p, '<p[^>]*>([^<]*)</p>', 1), '[\\s ]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(regexp_extract(p, '<p[^>]*>([^<]*)</p>', 1), '[\\s ]+', ' ', 'g')), ' ')) END) AS BIGINT) AS words
    FROM p GROUP BY id, NULLIF(regexp_extract(p, 'data-originallang="(\\w+)"', 1), '')""")  # fmt: skip
def paragraph_words(s, d):
    """Words by the original language of the paragraph."""
    st = statements(s, d, "content_en", "feed").filter("feed <> 'live_captions'")
    p = st.select("id", F.explode(tx.paragraphs(F.col("content_en"))).alias("p")).select("id", "p.original", tx.word_count(F.col("p.body")).alias("w"))
    return p.groupBy("id", "original").agg(F.count("*").alias("n"), F.sum("w").cast("long").alias("words"))


@query("f14_person_parts", BASE + """, a AS (SELECT id, NULLIF(regexp_extract(who_en, '\\(([^)]*)\\)', 1), '') AS inn, trim(regexp_replace(who_en, ' ?\\([^)]*\\)?', '', 'g')) AS outr FROM st),
    b AS (SELECT *, regexp_matches(outr, '^(The|An?|Some) ') AS office FROM a)
    SELECT id, CASE WHEN office AND inn IS NOT NULL THEN regexp_replace(inn, '^(Right Hon\\.|Hon\\.|Mr\\.|Mrs\\.|Ms\\.|Miss|Dr\\.|Mme|M\\.) +', '') ELSE regexp_replace(outr, '^(Right Hon\\.|Hon\\.|Mr\\.|Mrs\\.|Ms\\.|Miss|Dr\\.|Mme|M\\.) +', '') END AS display,
    CASE WHEN office THEN outr ELSE inn END AS post FROM b""")  # fmt: skip
def person_parts(s, d):
    return _who(s, d).select("id", tx.person_parts(F.col("who_en")).alias("x")).select("id", "x.display", "x.post")


@query("f28_guids", BASE + "SELECT id, CASE WHEN length(description_en) > 50 THEN sha1(description_en) ELSE description_en END AS guid FROM vq")
def guids(s, d):
    return questions(s, d).select("id", tx.guid(F.col("description_en")).alias("guid"))


@query("d5_month_ranges", BASE + "SELECT DISTINCT strftime(date, '%Y-%m') AS asked, CAST(date_trunc('month', date) AS TIMESTAMP) AS lo, CAST(last_day(date) + 1 AS TIMESTAMP) + INTERVAL 61 SECOND AS hi FROM vq")
def month_ranges(s, d):
    got = questions(s, d).select(F.date_format("date", "yyyy-MM").alias("asked")).distinct().withColumn("r", dt.month_range(F.col("asked")))
    return got.select("asked", "r.lo", "r.hi")


@query("d6_d8_ages", BASE + "SELECT id, CAST(date_trunc('month', date - INTERVAL 60 DAY) AS DATE) AS horizon, date_diff('day', date, DATE '2018-12-31') > 365 AS stale FROM vq")
def ages(s, d):
    return questions(s, d).select("id", dt.horizon(F.col("date")).alias("horizon"), dt.is_stale(F.col("date"), F.lit("2018-12-31").cast("date"), 365).alias("stale"))



QUERIES, ORACLE = REGISTRY.queries, REGISTRY.sql
