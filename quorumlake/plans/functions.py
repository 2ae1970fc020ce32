"""Scalar functions over the tables, with SQL (ids F, D, N, P20, P22, A29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.catalog import once, table
from quorumlake.functions import dates as dt
from quorumlake.functions import markup as mk
from quorumlake.functions import text as tx
from quorumlake.operators import lines
from quorumlake.plans.debates import SAID, _said
from quorumlake.plans.records import BASE, members, people, questions, statements
from quorumlake.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

_TITLE = r"array_to_string(list_transform(regexp_extract_all({0}, '\p{{L}}+|\P{{L}}+'), lambda x: upper(x[1]) || lower(x[2:])), '')"


@query("f4_titles", BASE + f"SELECT id, CASE WHEN regexp_matches(who_en, '[a-z]') THEN who_en ELSE {_TITLE.format('who_en')} END AS who, CASE WHEN upper(h1_en) <> lower(h1_en) AND (upper(h1_en) = h1_en OR lower(h1_en) = h1_en) THEN {_TITLE.format('h1_en')} ELSE h1_en END AS heading FROM st")
def titles(s, d):
    return statements(s, d, "who_en", "h1_en").select("id", tx.title_if_necessary(F.col("who_en")).alias("who"), tx.smart_title(F.col("h1_en")).alias("heading"))


@query("f7_labels", BASE + r"SELECT id, regexp_matches(who_en, '^(?:The\s(?:Speaker|Chair|Deputy|Acting)|Le\sprésident|An\s[hH]on\.?\s|Une\svoix|Des\svoix|Some\s[hH]on\.\s|Acting\s|Assistant\s)') AS office, regexp_replace(who_en, '\s*\(.+\)\s*', '', 'g') AS bare FROM st")
def labels(s, d):
    return statements(s, d, "who_en").select("id", tx.is_office(F.col("who_en")).alias("office"), tx.without_parens(F.col("who_en")).alias("bare"))


@query("f13_floor_text", BASE + """, x AS (SELECT id, content_en, content_fr, string_split(content_en, chr(10)) AS e, string_split(content_fr, chr(10)) AS f FROM st WHERE feed <> 'live_captions')
    SELECT id, CASE WHEN COALESCE(content_fr, '') = '' OR len(e) <> len(f) THEN content_en ELSE array_to_string(list_transform(range(1, len(e) + 1),
    lambda i: CASE WHEN instr(e[i], 'data-originallang="') <> 1 AND substr(e[i], instr(e[i], 'data-originallang="') + 19, 2) = 'fr' THEN f[i] ELSE e[i] END), chr(10)) END AS floor FROM x""")  # fmt: skip
def floor_text(s, d):
    st = statements(s, d, "content_en", "content_fr", "feed").filter("feed <> 'live_captions'")
    return st.select("id", tx.floor_text(F.col("content_en"), F.col("content_fr")).alias("floor"))


@query("f15_english_list", BASE + """, p AS (SELECT DISTINCT pv.votequestion_id AS v, party.slug FROM pv JOIN party ON party.id = pv.party_id WHERE pv.vote = 'Y'), g AS (SELECT v, list(slug ORDER BY slug) AS l FROM p GROUP BY v)
    SELECT v AS votequestion_id, CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) = 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[:-2], ', ') || ',  and ' || l[-1] END AS parties,
    array_to_string(list_transform(list_filter(l, lambda x: x <> 'ndp'), lambda x: '/parties/' || x), ' ') AS urls FROM g""")  # fmt: skip
def english_lists(s, d):
    pv = once(table(s, d, "party_vote"), "id").filter("vote = 'Y'").join(F.broadcast(table(s, d, "party").select(F.col("id").alias("party_id"), "slug")), "party_id")
    got = pv.groupBy("votequestion_id").agg(F.sort_array(F.collect_set("slug")).alias("l"))  # seven parties
    return got.select("votequestion_id", tx.english_list(F.col("l")).alias("parties"), F.array_join(tx.list_prefix(tx.list_filter(F.col("l"), F.lit("ndp")), "/parties/"), " ").alias("urls"))


@query("f15_phrases", BASE + r"""SELECT id, CASE WHEN number <= 45 THEN CAST(number AS VARCHAR) || ' minutes' WHEN round_even(number / 60.0, 0) = 1 THEN '1 hour' ELSE CAST(CAST(round_even(number / 60.0, 0) AS INTEGER) AS VARCHAR) || ' hours' END AS lasted,
    monthname(date) AS month, regexp_replace(CASE WHEN regexp_matches(t, 'An Act (?:to )?[a-z]') THEN regexp_replace(regexp_extract(t, '^(.*?)An Act (?:to )?[a-z]', 1), 'x', 'x') || upper(regexp_extract(t, 'An Act (?:to )?([a-z])', 1)) || regexp_extract(t, 'An Act (?:to )?[a-z](.*)$', 1) ELSE t END, ' Act$', '') AS title
    FROM (SELECT *, 'An Act to ' || lower(description_en) || ' Act' AS t FROM vq)""")  # fmt: skip
def phrases(s, d):
    t = F.concat(F.lit("An Act to "), F.lower("description_en"), F.lit(" Act"))
    return questions(s, d).select("id", tx.friendly_minutes(F.col("number")).alias("lasted"), tx.month_name(F.month("date")).alias("month"), tx.strip_act(t).alias("title"))


@query("f15_pronouns", BASE + "SELECT id, CASE gender WHEN 'F' THEN 'She' WHEN 'M' THEN 'He' ELSE 'He/she' END AS subject, CASE gender WHEN 'F' THEN 'Her' WHEN 'M' THEN 'His' ELSE 'Their' END AS possessive, CASE gender WHEN 'F' THEN 'Her' WHEN 'M' THEN 'Him' ELSE 'Them' END AS object, CASE gender WHEN 'F' THEN 'Ms.' WHEN 'M' THEN 'Mr.' ELSE 'Mr./Ms.' END AS title FROM pol")
def pronouns(s, d):
    return people(s, d).select("id", *[tx.pronoun(k, F.col("gender")).alias(k) for k in tx.PRONOUNS])


@query("f16_time_since", BASE + """SELECT id, CASE WHEN n < 1 THEN 'Today' WHEN n = 1 THEN 'Yesterday' WHEN n = 2 THEN 'Two days ago' WHEN n = 3 THEN 'Three days ago' WHEN n < 7 THEN 'This week' WHEN n < 14 THEN 'A week ago'
    WHEN n < 21 THEN 'Two weeks ago' WHEN n < 28 THEN 'Three weeks ago' WHEN n < 45 THEN 'A month ago' WHEN n < 75 THEN 'Two months ago' WHEN n < 105 THEN 'Three months ago' ELSE 'More than three months ago' END AS since
    FROM (SELECT id, date_diff('day', CAST(time AS DATE), DATE '2017-06-30') AS n FROM st)""")  # fmt: skip
def time_since(s, d):
    return statements(s, d, "time").select("id", dt.time_since(F.to_date("time"), F.lit("2017-06-30").cast("date")).alias("since"))


@query("f17_markdown", BASE + r'''SELECT id, regexp_replace(regexp_replace(t, '\[([^\]]+)\]\(([^)]+)\)', '<a href="\2">\1</a>', 'g'), '\*\*([^*]+)\*\*', '<strong>\1</strong>', 'g') AS html,
    regexp_replace(t, '\[([^\]]+)\]\([^)]+\)', '\1', 'g') AS plain FROM (SELECT id, '**' || slug || '** [' || name || '](/politicians/' || slug || '/)' AS t FROM pol)''')  # fmt: skip
def markdown(s, d):
    t = F.concat(F.lit("**"), F.col("slug"), F.lit("** ["), F.col("name"), F.lit("](/politicians/"), F.col("slug"), F.lit("/)"))
    return people(s, d).select("id", tx.markdown_links(t).alias("html"), tx.strip_markdown_links(t).alias("plain"))


@query("f18_alert_text", BASE + "SELECT id, '**' || who_en || '** & it''s' AS said FROM st WHERE who_en NOT LIKE '%&%' AND who_en NOT LIKE '%<%'")
def alert_text(s, d):
    st = statements(s, d, "who_en").filter(~F.col("who_en").contains("&") & ~F.col("who_en").contains("<"))
    return st.select("id", mk.plain_alert(F.concat(F.lit("<em>"), F.col("who_en"), F.lit("</em> &amp; it&#39;s"))).alias("said"))


@query("f20_round_trip", "SELECT event_id, event_id AS back FROM events")
def codec(s, d):
    """Numbers as short texts and back."""
    e = table(s, d, "events").select("event_id", tx.encode_id("event_id").alias("t"))
    return e.select("event_id", tx.decode_id("t").alias("back"))


@query("f21_munged", BASE + r"""SELECT id, CASE WHEN source_id = '' OR source_id = '&nbsp;' OR contains(source_id, '0000') THEN NULL ELSE source_id END AS day, TRY_CAST(regexp_replace(source_id, '\D', '', 'g') AS BIGINT) AS number,
    COALESCE(TRY_CAST(replace(CAST(wordcount AS VARCHAR) || ',5', ',', '') AS DECIMAL(20, 4)), 0) AS amount, NULLIF(regexp_extract(CAST(time AS VARCHAR), '(\d\d:\d\d:\d\d)', 1), '') AS clock FROM st""")  # fmt: skip
def munged(s, d):
    st = statements(s, d, "source_id", "wordcount", "time")
    return st.select(
        "id", tx.munge_date(F.col("source_id")).alias("day"), tx.munge_int(F.col("source_id")).alias("number"),
        tx.munge_decimal(F.concat(F.col("wordcount").cast("string"), F.lit(",5"))).alias("amount"), tx.munge_time(F.col("time").cast("string")).alias("clock"),
    )


_CODE = "'k' || CAST(id % 10 AS VARCHAR) || 'a' || CASE WHEN id % 3 = 0 THEN ' ' ELSE '' END || CAST(id % 7 AS VARCHAR) || CASE WHEN id % 5 = 0 THEN 'zz' ELSE 'b1' END"


@query("f22_postcodes", BASE + f"SELECT id, CASE WHEN regexp_matches(upper(c), '^\\s*[A-Z]\\d[A-Z]\\s*\\d[A-Z]\\d\\s*$') THEN replace(upper(c), ' ', '') END AS code, CASE WHEN regexp_matches(m, '^[ABCEGHJKLMNPRSTVXYZ]\\d[A-Z] \\d[A-Z]\\d$') THEN m END AS spaced FROM (SELECT id, {_CODE} AS c, CASE WHEN length({_CODE}) = 6 THEN substr(upper({_CODE}), 1, 3) || ' ' || substr(upper({_CODE}), 4) ELSE upper({_CODE}) END AS m FROM pol)")
def postcodes(s, d):
    c = F.concat(F.lit("k"), (F.col("id") % 10).cast("string"), F.lit("a"), F.when(F.col("id") % 3 == 0, " ").otherwise(""), (F.col("id") % 7).cast("string"), F.when(F.col("id") % 5 == 0, "zz").otherwise("b1"))
    return people(s, d).select("id", tx.postcode(c).alias("code"), tx.munge_postcode(c).alias("spaced"))


@query("f23_sessions", BASE + "SELECT DISTINCT session_id, session_id AS back FROM vq")
def sessions(s, d):
    said = F.concat(F.split_part("session_id", F.lit("-"), F.lit(1)), F.lit("nd Parliament, "), F.split_part("session_id", F.lit("-"), F.lit(2)), F.lit("st Session"))
    return questions(s, d).select("session_id").distinct().select("session_id", tx.session_id(said).alias("back"))


@query("f24_stages", BASE + r"""SELECT id, CASE WHEN regexp_matches(description_en, '(?is)^\s*(?:Projet de loi|Bill)\s+([CS]).(\d+)[,:\-.\s]+(.+)') THEN
      regexp_extract(description_en, '(?is)^\s*(?:Projet de loi|Bill)\s+([CS]).(\d+)[,:\-.\s]+(.+)', 1) || '-' || regexp_extract(description_en, '(?is)^\s*(?:Projet de loi|Bill)\s+([CS]).(\d+)[,:\-.\s]+(.+)', 2) || ',' ||
      CASE WHEN t LIKE '%first reading%' THEN '1' WHEN t LIKE '%première lecture%' THEN '1' WHEN t LIKE '%senate%' OR t LIKE '%du sénat%' THEN 'senate' WHEN t LIKE '%second reading%' OR t LIKE '%deuxième lecture%' THEN '2'
      WHEN t LIKE '%third reading%' OR t LIKE '%troisième lecture%' THEN '3' WHEN t LIKE '%report stage%' OR t LIKE '%étape du rapport%' THEN 'report' ELSE 'other[' || regexp_extract(description_en, '(?is)^\s*(?:Projet de loi|Bill)\s+([CS]).(\d+)[,:\-.\s]+(.+)', 3) || ']' END
      WHEN regexp_matches(t, 'first reading|première lecture') THEN 'C-1,1' WHEN regexp_matches(t, 'senate|du sénat') THEN 'C-1,senate' WHEN regexp_matches(t, 'second reading|deuxième lecture') THEN 'C-1,2'
      WHEN regexp_matches(t, 'third reading|troisième lecture') THEN 'C-1,3' WHEN regexp_matches(t, 'report stage|étape du rapport') THEN 'C-1,report' ELSE 'C-1,2' END AS stage
    FROM (SELECT *, lower(description_en) AS t FROM vq)""")  # fmt: skip
def stages(s, d):
    """The stage after each vote's description, with second reading of C-1 before it."""
    return questions(s, d).select("id", mk.bill_stage(F.col("description_en"), F.lit("C-1,2")).alias("stage"))


@query("f29_tags", BASE + """SELECT id, '<a class="x&quot;y" data-HoCid="' || CAST(id AS VARCHAR) || '"' || CASE WHEN slug = '' THEN '' ELSE ' href="/politicians/' || slug || '/"' END || '>' AS tag FROM pol""")
def tags(s, d):
    at = F.create_map(F.lit("href"), F.concat(F.lit("/politicians/"), F.nullif("slug", F.lit("")), F.lit("/")), F.lit("data-HoCid"), F.col("id").cast("string"), F.lit("class"), F.lit('x"y'))
    return people(s, d).select("id", tx.tag("a", at).alias("tag"))


@query("f31_f40_shortened", BASE + """SELECT id, CASE WHEN length(t) >= 150 THEN CASE WHEN description_fr <> '' THEN description_fr ELSE substr(t, 1, 140) || '…' END ELSE t END AS title, substr(t, 1, 200) AS subject,
    CASE WHEN len(string_split(t, ' ')) > 12 THEN array_to_string(string_split(t, ' ')[1:12], ' ') || '…' ELSE t END AS w12, CASE WHEN len(string_split(t, ' ')) > 26 THEN array_to_string(string_split(t, ' ')[1:26], ' ') || '…' ELSE t END AS w26
    FROM (SELECT *, description_en || ' ' || description_en || ' ' || description_en AS t FROM vq)""")  # fmt: skip
def shortened(s, d):
    t = F.concat_ws(" ", "description_en", "description_en", "description_en")
    return questions(s, d).select("id", tx.bill_title(t, F.col("description_fr")).alias("title"), F.left(t, F.lit(200)).alias("subject"), tx.first_words(t, 12).alias("w12"), tx.first_words(t, 26).alias("w26"))


@query("f34_links", BASE + "SELECT id, CASE WHEN id % 2 = 0 THEN '/politicians/' || slug || '/' ELSE '' END AS invalid FROM pol")
def links(s, d):
    """Targets of links that aren't among the known addresses: every second one here."""
    url = F.concat(F.lit("/politicians/"), F.col("slug"), F.lit("/"))
    t = F.concat(F.lit("see ["), F.col("name"), F.lit("]("), url, F.lit(")"))
    return people(s, d).select("id", F.array_join(mk.valid_links(t, F.array(F.when(F.col("id") % 2 == 1, url).otherwise("x"))), " ").alias("invalid"))


@query("f36_legacy_names", BASE + r"SELECT id, replace(regexp_replace(who, 'Mc(\w)', 'Mc|\1', 'g'), '|', '') AS who FROM (SELECT id, 'McZ' || lower(replace(who_en, 'Mc', '')) AS who FROM st)")
def legacy_names(s, d):
    st = statements(s, d, "who_en")
    return st.select("id", mk.tame_legacy(tx.mc_names(F.concat(F.lit("Mcz"), F.lower(F.replace(F.col("who_en"), F.lit("Mc"), F.lit("")))))).alias("who"))


@query("f37_urls", BASE + """SELECT id, '/votes/' || session_id || '/' || CAST(number AS VARCHAR) || '/' AS url, '/bills/' || session_id || '/C-' || CAST(bill_id AS VARCHAR) || '/' AS bill_url,
    '/debates/' || CAST(year(date) AS VARCHAR) || '/' || CAST(month(date) AS VARCHAR) || '/' || CAST(day(date) AS VARCHAR) || '/' AS debate_url, '/votes/' || session_id || '/' AS above, 'bills.votequestion.' || CAST(id AS VARCHAR) AS index_id FROM vq WHERE bill_id IS NOT NULL""")  # fmt: skip
def urls(s, d):
    q = questions(s, d).filter("bill_id is not null")
    url = tx.vote_url(F.col("session_id"), F.col("number"))
    return q.select(
        "id", url.alias("url"), tx.bill_url(F.col("session_id"), F.concat(F.lit("C-"), F.col("bill_id").cast("string"))).alias("bill_url"), tx.debate_url(F.col("date")).alias("debate_url"),
        tx.above(url).alias("above"), F.concat(F.lit("bills.votequestion."), F.col("id").cast("string")).alias("index_id"),
    )


@query("f37_people_urls", BASE + "SELECT st.id, '/politicians/' || pol.slug || '/' AS person, '/politicians/roles/' || CAST(st.member_id AS VARCHAR) || '/' AS role, '/committees/health/42-1/' || CAST(st.sequence AS VARCHAR) || '/' AS meeting FROM st JOIN pol ON pol.id = st.politician_id")
def people_urls(s, d):
    who = people(s, d).select(F.col("id").alias("politician_id"), F.col("slug").alias("_slug"))
    st = statements(s, d, "politician_id", "member_id", "sequence").join(who, "politician_id")
    meeting = F.when(F.col("sequence").isNotNull(), tx.meeting_url(F.lit("health"), F.lit("42-1"), F.col("sequence")))
    return st.select("id", tx.person_url(F.col("_slug"), F.col("politician_id")).alias("person"), tx.role_url(F.col("member_id")).alias("role"), meeting.alias("meeting"))


@query("f39_shared", BASE + "SELECT id, CASE WHEN n > 139 THEN substr(t, 1, 136 - length(u)) || '...' WHEN n + 9 < 140 THEN t || ' (shared)' ELSE t END || ' ' || u AS message FROM (SELECT *, length(t) + length(u) AS n FROM (SELECT id, description_en || ' ' || description_en AS t, '/votes/' || session_id || '/' || CAST(number AS VARCHAR) || '/' AS u FROM vq))")
def shared(s, d):
    q = questions(s, d)
    return q.select("id", tx.shared_text(F.concat_ws(" ", "description_en", "description_en"), tx.vote_url(F.col("session_id"), F.col("number")), " (shared)").alias("message"))


@query("d1_d3_clock", BASE + "SELECT id, CAST(date AS TIMESTAMP) + to_minutes(CAST(23 * 60 + number * 7 AS BIGINT)) AS at, CAST(CASE WHEN number % 12 + 1 = 12 THEN CASE WHEN number % 2 = 0 THEN 12 ELSE 0 END ELSE number % 12 + 1 + CASE WHEN number % 2 = 0 THEN 12 ELSE 0 END END AS INTEGER) AS hour FROM vq")
def clock(s, d):
    half = F.when(F.col("number") % 2 == 0, "p.m.").otherwise("a.m.")
    return questions(s, d).select("id", dt.clock(F.col("date"), F.lit(23), F.col("number") * 7).alias("at"), dt.hour24(F.col("number") % 12 + 1, half).cast("int").alias("hour"))


@query("d2_house_met", BASE + "SELECT id, CAST(date AS TIMESTAMP) + to_minutes(CAST((number % 12) * 60 + CASE WHEN id % 2 = 0 THEN 720 ELSE 0 END + number % 60 AS BIGINT)) AS at FROM vq")
def house_met(s, d):
    hour = F.when(F.col("number") % 12 == 0, 12).otherwise(F.col("number") % 12)
    words = F.concat(F.lit("The House met at "), hour.cast("string"), F.lit(":"), F.lpad((F.col("number") % 60).cast("string"), 2, "0"), F.when(F.col("id") % 2 == 0, " p.m.").otherwise(" a.m."))
    return questions(s, d).select("id", dt.house_met(words, F.col("date")).alias("at"))


@query("d4_days", BASE + "SELECT id, date AS named, date AS leading FROM vq")
def days(s, d):
    return questions(s, d).select("id", dt.named_day(F.date_format("date", "MMMM d, yyyy")).alias("named"), dt.leading_day(F.concat(F.col("date").cast("string"), F.lit("T10:00:00"))).alias("leading"))


@query("d7_g9_due", BASE + "SELECT id FROM st WHERE date_diff('day', CAST(time AS DATE), DATE '2018-03-05') IN (1, 2, 3, 7, 14, 21, 30, 50, 100, 150, 200, 300, 400, 550, 700, 1000)")
def due(s, d):
    """What is fetched again on a day, ever more seldom as it grows older."""
    st = statements(s, d, "time")
    return st.filter(dt.is_due(F.lit(None).cast("date"), F.to_date("time"), F.lit("2018-03-05").cast("date"))).select("id")


@query("d10_meetings", BASE + "SELECT id, CAST(date AS TIMESTAMP) + to_minutes(CAST(570 + number AS BIGINT)) AS starts, CAST(date AS TIMESTAMP) + to_minutes(CAST(570 + number AS BIGINT)) > TIMESTAMP '2017-06-01 00:00:00' AS later FROM vq")
def meetings(s, d):
    at = dt.meets_at(F.col("date"), F.lit(9), 30 + F.col("number"))
    return questions(s, d).select("id", at.alias("starts"), dt.is_future(at, F.lit("2017-06-01").cast("timestamp_ntz")).alias("later"))


_EDID = "CAST(CASE riding_id % 13 WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 12 WHEN 3 THEN 13 WHEN 4 THEN 24 WHEN 5 THEN 35 WHEN 6 THEN 46 WHEN 7 THEN 47 WHEN 8 THEN 48 WHEN 9 THEN 59 WHEN 10 THEN 60 WHEN 11 THEN 61 ELSE 62 END AS VARCHAR)"


@query("flt_p20_province", BASE + f"SELECT DISTINCT riding_id, CASE {_EDID} WHEN '10' THEN 'NL' WHEN '11' THEN 'PE' WHEN '12' THEN 'NS' WHEN '13' THEN 'NB' WHEN '24' THEN 'QC' WHEN '35' THEN 'ON' WHEN '46' THEN 'MB' WHEN '47' THEN 'SK' WHEN '48' THEN 'AB' WHEN '59' THEN 'BC' WHEN '60' THEN 'YT' WHEN '61' THEN 'NT' WHEN '62' THEN 'NU' END AS province FROM em WHERE riding_id IS NOT NULL")
def provinces(s, d):
    """The tables' ridings have no district number; one is made of them, with each prefix."""
    first = F.element_at(F.array(*[F.lit(int(k)) for k in tx.DISTRICTS]), (F.col("riding_id") % 13 + 1).cast("int"))
    return members(s, d).filter("riding_id is not null").select("riding_id").distinct().select("riding_id", tx.district_province(first * 1000 + F.col("riding_id") % 1000).alias("province"))


@query("flt_p22_line_rules", BASE + r"""SELECT id, regexp_matches(t, '^[A-Z]') AS first_ok, NOT (regexp_matches(t, '(?i)(Mr|St|Mrs|No|Hon)\.$') OR regexp_matches(t, '[:-]$')) AS last_ok, NOT (regexp_matches(t, '\d') OR contains(t, '[') OR contains(t, '—') OR contains(t, '--')) AS line_ok
    FROM (SELECT id, content_en AS t FROM st WHERE feed = 'live_captions')""")  # fmt: skip
def line_rules(s, d):
    st = statements(s, d, "content_en", "feed").filter("feed = 'live_captions'")
    t = F.col("content_en")
    return st.select("id", lines.first_ok(t).alias("first_ok"), lines.last_ok(t).alias("last_ok"), lines.line_ok(t).alias("line_ok"))


@query("a29_n4_n5_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS tokens, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def replies(s, d):
    """Tokens summed over a list of two, and the JSON of a reply in a code fence."""
    e = table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), "props")
    meta = F.concat(F.lit('[{"total_tokens": '), F.col("k").cast("string"), F.lit('}, {"total_tokens": '), F.col("k").cast("string"), F.lit("}]"))
    return e.select("event_id", mk.token_sum(meta).alias("tokens"), mk.fenced_json(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), "k long")["k"].alias("k"))


@query("n4_bounces", BASE + "SELECT slug || '@x' AS address, 'bounce' AS kind FROM pol WHERE id % 2 = 0")
def bounces(s, d):
    """Notices whose body holds JSON in a text; those of even numbers are for good."""
    inner = F.to_json(F.struct(F.lit("Bounce").alias("notificationType"), F.struct(
        F.when(F.col("id") % 2 == 0, "Permanent").otherwise("Transient").alias("bounceType"), F.array(F.struct(F.concat("slug", F.lit("@x")).alias("emailAddress"))).alias("bouncedRecipients")).alias("bounce")))
    return mk.bounces(people(s, d).select(F.to_json(F.struct(inner.alias("Message"))).alias("body")), "body")


@query("f11_marked_text", SAID + r"""SELECT id, trim(regexp_replace(replace(regexp_replace(content_en, '<p[^>]*data-HoCid="(\d+)"[^>]*>', '[URLMARK#\1] ', 'g'), 'URLMARK', '/s/' || CAST(id AS VARCHAR) || '/'), '<[^>]*>', '', 'g'), ' ') AS body FROM sd""")
def marked(s, d):
    url = F.concat(F.lit("/s/"), F.col("id").cast("string"), F.lit("/"))
    return _said(s, d, "content_en").select("id", mk.marked_text(F.col("content_en"), url).alias("body"))


@query("f38_unique_slugs", BASE + "SELECT id, slug || CASE WHEN rn > 1 THEN '-' || CAST(rn AS VARCHAR) ELSE '' END AS slug FROM (SELECT id, lower(name_family) AS slug, row_number() OVER (PARTITION BY lower(name_family) ORDER BY id) AS rn FROM pol)")
def unique(s, d):
    p = people(s, d).select("id", F.lower("name_family").alias("base"))
    return mk.unique_slugs(p, "base", F.col("id")).select("id", "slug")


QUERIES, ORACLE = REGISTRY.queries, REGISTRY.sql
