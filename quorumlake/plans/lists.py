"""The eight list resources, their rows as JSON, and bills (ids P7, P11, P12, P18, P19, P23, P24, K7, K8, K16).

The tables have no bills, sittings or committees of their own: bills are made of the votes on them, sittings of the statements
of a document, committees and meetings of the documents that are evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.catalog import once, table
from quorumlake.functions import text as tx
from quorumlake.operators import bills as bl
from quorumlake.operators import resources as rs
from quorumlake.plans.records import BASE, ballots, members, people, questions, statements
from quorumlake.plans.registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

_MORE = """, bill AS (SELECT bill_id AS id, min(session_id) AS session, 'C-' || CAST(bill_id * 12 AS VARCHAR) AS number, min(date) AS introduced, max(date) AS status_date,
  CASE bill_id % 4 WHEN 0 THEN 'RoyalAssentGiven' WHEN 1 THEN 'HouseAt2ndReading' WHEN 2 THEN 'BillNotActive' ELSE 'x' END AS status_code, bill_id % 50 + 1 AS sponsor_politician_id FROM vq WHERE bill_id IS NOT NULL GROUP BY bill_id),
deb AS (SELECT document_id AS id, 'D' AS document_type, min(CAST(time AS DATE)) AS date, CAST(count(*) AS VARCHAR) AS number FROM st WHERE feed <> 'live_captions' GROUP BY document_id),
meet AS (SELECT doc_id AS id, source AS committee, session_id AS session, CAST(doc_id % 100 AS INTEGER) AS number, published_on AS date, doc_id % 2 = 0 AS in_camera, doc_id AS evidence_id FROM documents WHERE doc_kind = 'evidence') """
MORE = BASE + _MORE


def bills(s, d):
    code = F.when(F.col("id") % 4 == 0, "RoyalAssentGiven").when(F.col("id") % 4 == 1, "HouseAt2ndReading").when(F.col("id") % 4 == 2, "BillNotActive").otherwise("x")
    b = questions(s, d).filter("bill_id is not null").groupBy(F.col("bill_id").alias("id")).agg(F.min("session_id").alias("session"), F.min("date").alias("introduced"), F.max("date").alias("status_date"))
    return bl.derived(b.select("*", F.concat(F.lit("C-"), (F.col("id") * 12).cast("string")).alias("number"), code.alias("status_code"), (F.col("id") % 50 + 1).alias("sponsor_politician_id")))


def votes(s, d):
    return questions(s, d).withColumnRenamed("session_id", "session")


def debates(s, d):
    st = statements(s, d, "document_id", "time", "feed").filter("feed <> 'live_captions'")
    return st.groupBy(F.col("document_id").alias("id")).agg(F.lit("D").alias("document_type"), F.min(F.to_date("time")).alias("date"), F.count("*").cast("string").alias("number"))


def meetings(s, d):
    e = table(s, d, "documents").filter("doc_kind = 'evidence'")
    return e.select(F.col("doc_id").alias("id"), F.col("source").alias("committee"), F.col("session_id").alias("session"), (F.col("doc_id") % 100).cast("int").alias("number"), F.col("published_on").alias("date"), (F.col("doc_id") % 2 == 0).alias("in_camera"), F.col("doc_id").alias("evidence_id"))


@query("flt_p11_bills", MORE + "SELECT id, number FROM bill WHERE session = '41-1' AND introduced > DATE '2016-01-10' AND bill.id * 12 >= 200 AND sponsor_politician_id IN (SELECT id FROM pol WHERE slug >= 'a')")
def bill_list(s, d):
    r = rs.bills(bills(s, d), people(s, d))
    return r.query({"session": "41-1", "introduced__gt": "2016-01-10", "private_member_bill": "True"}).join(people(s, d).filter("slug >= 'a'").select(F.col("id").alias("sponsor_politician_id")), "sponsor_politician_id", "left_semi").select("id", "number")


@query("flt_p11_sponsored", MORE + "SELECT id FROM bill WHERE sponsor_politician_id = 12 OR (NOT status_code = 'RoyalAssentGiven' AND sponsor_politician_id = 13)")
def sponsored(s, d):
    r = rs.bills(bills(s, d), people(s, d))
    return r.query({"sponsor_politician": "12"}).select("id").unionByName(r.query({"sponsor_politician": "/politicians/13/", "law": "False"}).select("id"))


@query("flt_p11_p7_votes", MORE + "SELECT vq.id FROM vq JOIN bill ON bill.id = vq.bill_id WHERE bill.session = '41-1' AND vq.result = 'Y' AND yea_total > 5 AND bill.number = (SELECT max(number) FROM bill WHERE session = '41-1') UNION ALL SELECT id FROM vq WHERE session_id = '41-1' AND number BETWEEN 3 AND 5")
def vote_list(s, d):
    b = bills(s, d)
    r = rs.votes(votes(s, d), b)
    # The address asked for is the one of the last bill of the session, given as a frame of one row.
    last = b.filter("session = '41-1'").agg(F.max("number").alias("number"))
    asked = b.join(F.broadcast(last), "number", "left_semi").filter("session = '41-1'")
    one = rs.votes(votes(s, d), asked).query({"result": "Passed", "yea_total__gt": "5"}).join(asked.select(F.col("id").alias("bill_id")), "bill_id", "left_semi")
    return one.select("id").unionByName(r.query({"session": "41-1", "number__range": "3,5"}).select("id"))


@query("flt_p7_key_path", BASE + "SELECT id, date FROM vq WHERE bill_id IN (SELECT bill_id FROM vq WHERE bill_id IS NOT NULL GROUP BY bill_id HAVING min(session_id) = '41-1' AND bill_id * 12 = 132)")
def key_path(s, d):
    return rs.votes(votes(s, d), bills(s, d)).query({"bill": "/bills/41-1/C-132/"}).select("id", "date")


@query("flt_p11_ballots", BASE + "SELECT id, politician_id FROM mv WHERE vote = 'N' AND dissent AND votequestion_id IN (SELECT id FROM vq WHERE session_id = '41-1') UNION ALL SELECT mv.id, politician_id FROM mv JOIN vq ON vq.id = mv.votequestion_id WHERE vq.session_id = '41-1' AND vq.number = 7 AND mv.vote = 'A'")
def ballot_list(s, d):
    r = rs.ballots(ballots(s, d), votes(s, d), people(s, d))
    first = r.query({"ballot": "No", "dissent": "True", "unknown": "x"}).join(votes(s, d).filter("session = '41-1'").select(F.col("id").alias("votequestion_id")), "votequestion_id", "left_semi")
    return first.select("id", "politician_id").unionByName(r.query({"vote": "/votes/41-1/7/", "ballot": "A"}).select("id", "politician_id"))


@query("flt_p11_politicians", BASE + "SELECT id, 'current' AS listed FROM pol WHERE EXISTS (SELECT 1 FROM em WHERE em.politician_id = pol.id AND end_date IS NULL) UNION ALL SELECT id, 'former' FROM pol WHERE EXISTS (SELECT 1 FROM em WHERE em.politician_id = pol.id) AND NOT EXISTS (SELECT 1 FROM em WHERE em.politician_id = pol.id AND end_date IS NULL) UNION ALL SELECT id, 'family' FROM pol WHERE name_family = 'Wistzorulv' AND EXISTS (SELECT 1 FROM em WHERE em.politician_id = pol.id)")
def politician_list(s, d):
    m = members(s, d)
    elected = people(s, d).join(m.select(F.col("politician_id").alias("id")), "id", "left_semi")
    r = rs.politicians(elected, m.filter("end_date is null"))
    of = lambda p, n: r.query(p).select("id", F.lit(n).alias("listed"))
    return of({}, "current").unionByName(of({"include": "former"}, "former")).unionByName(of({"include": "all", "family_name": "Wistzorulv"}, "family"))


@query("flt_p11_p12_speeches", MORE + """, spoken AS (SELECT id, document_id, sequence FROM st WHERE document_id IN (SELECT id FROM deb WHERE date = DATE '2016-03-09') AND NOT procedural)
    SELECT id, document_id, sequence FROM spoken UNION ALL SELECT id, document_id, sequence FROM st WHERE politician_id = 21 AND time BETWEEN TIMESTAMP '2016-03-01 00:00:00' AND TIMESTAMP '2018-05-01 00:00:00'
    UNION ALL SELECT st.id, document_id, sequence FROM st WHERE id IN (SELECT st.id FROM st JOIN vq ON vq.session_id = '41-1' AND vq.bill_id = 11 AND st.politician_id IS NOT NULL AND st.politician_id % 7 = 0)""")  # fmt: skip
def speech_list(s, d):
    st = statements(s, d, "document_id", "sequence", "politician_id", "member_id", "procedural", "time").withColumn("bill_debated_id", F.lit(None).cast("long"))
    # Who is divisible by seven stands for a mention of bill 11, of which there are no records.
    mentions = st.filter("politician_id % 7 = 0").select(F.col("id").alias("statement_id"), "politician_id", F.lit(11).cast("long").alias("bill_id"))
    r = rs.speeches(st, people(s, d), bills(s, d), debates(s, d), meetings(s, d), mentions)
    cols = ("id", "document_id", "sequence")
    got = r.query({"document": "/debates/2016/3/9/", "procedural": "false"}).select(*cols)
    got = got.unionByName(r.query({"politician": "21", "time__range": "2016-03-01 00:00:00,2018-05-01 00:00:00"}).select(*cols))
    return got.unionByName(r.query({"mentioned_bill": "/bills/41-1/C-132/"}).select(*cols))


@query("flt_p11_debates", MORE + "SELECT id, date FROM deb WHERE date BETWEEN DATE '2016-03-01' AND DATE '2017-03-01'")
def debate_list(s, d):
    return rs.debates(debates(s, d).withColumn("session", F.lit("41-1"))).query({"date__range": "2016-03-01,2017-03-01", "session": "41-1"}).select("id", "date")


@query("flt_p11_committees", "SELECT DISTINCT source AS name FROM documents WHERE doc_kind = 'evidence' AND session_id = '41-2' AND source IS NOT NULL UNION ALL SELECT DISTINCT source FROM documents WHERE doc_kind = 'evidence' AND session_id = '41-1' AND source IS NOT NULL")
def committee_list(s, d):
    m = meetings(s, d).filter("committee is not null")
    c = m.select(F.col("committee").alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("display"))
    r = rs.committees(c, m.select(F.col("committee").alias("committee_id"), "session").distinct(), "41-2")
    return r.query({}).select("name").unionByName(r.query({"session": "41-1"}).select("name"))


@query("flt_p11_meetings", MORE + "SELECT id, date FROM meet WHERE committee = 'petitions' AND session = '41-1' AND in_camera UNION ALL SELECT id, date FROM meet WHERE number < 3 AND date > DATE '2018-01-01'")
def meeting_list(s, d):
    r = rs.meetings(meetings(s, d))
    return r.query({"committee": "/committees/petitions/", "session": "41-1", "in_camera": "True"}).select("id", "date").unionByName(r.query({"number__lt": "3", "date__gt": "2018-01-01"}).select("id", "date"))


# --- bills, rows as JSON ----------------------------------------------------------------------------------------------------


@query("flt_p18_p19_bills", MORE + """SELECT id, CAST(id * 12 AS INTEGER) AS number_only, id * 12 >= 200 AS privatemember, 'C' AS institution, status_code = 'RoyalAssentGiven' AS law,
    CASE status_code WHEN 'RoyalAssentGiven' THEN 'Law (royal assent given)' WHEN 'HouseAt2ndReading' THEN 'Second reading (House)' WHEN 'BillNotActive' THEN 'Not active' ELSE 'Unknown' END AS status,
    status_code = 'BillNotActive' AS dead, date_diff('day', status_date, DATE '2018-01-01') > 150 AS dormant, status_date AS latest_date FROM bill""")  # fmt: skip
def bill_properties(s, d):
    got = bl.computed(bills(s, d), F.lit("2018-01-01").cast("date"))
    return got.select("id", "number_only", "privatemember", "institution", "law", "status", "dead", "dormant", "latest_date")


def _vote_rows(s, d):
    b = bills(s, d).select(F.col("id").alias("bill_id"), tx.bill_url(F.col("session"), F.col("number")).alias("bill_url"))
    pv = once(table(s, d, "party_vote"), "id").join(F.broadcast(table(s, d, "party").select(F.col("id").alias("party_id"), "name_en", "short_name_en")), "party_id")  # fixed, 7 rows
    label = rs._labelled(rs.BALLOTS | {"F": "Free vote"}, F.col("vote"))
    party = F.struct(F.struct(F.col("name_en").alias("en")).alias("name"), F.struct(F.col("short_name_en").alias("en")).alias("short_name"))
    lines = pv.groupBy(F.col("votequestion_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").alias("i"), label.alias("vote"), party.alias("party")))), lambda x: F.struct(x["vote"].alias("vote"), x["party"].alias("party"))).alias("party_votes"))
    return votes(s, d).join(b, "bill_id", "left").join(lines, "id", "left")


_VOTE = """'bill_url', CASE WHEN b.id IS NULL THEN NULL ELSE '/bills/' || b.session || '/' || b.number || '/' END, 'session', vq.session_id, 'number', vq.number, 'date', CAST(vq.date AS VARCHAR),
  'description', json_object('en', description_en, 'fr', description_fr), 'result', CASE result WHEN 'Y' THEN 'Passed' WHEN 'N' THEN 'Failed' WHEN 'T' THEN 'Tie' END, 'yea_total', yea_total, 'nay_total', nay_total, 'paired_total', paired_total"""


@query("k7_k8_votes", MORE + f"SELECT vq.id, CAST(json_object({_VOTE}) AS VARCHAR) AS json FROM vq LEFT JOIN bill b ON b.id = vq.bill_id")
def votes_json(s, d):
    return rs.as_json(_vote_rows(s, d), "id", rs.vote_fields())


@query("k8_vote_details", MORE + f""", pl AS (SELECT votequestion_id AS id, list(json_object('vote', CASE vote WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' WHEN 'P' THEN 'Paired' WHEN 'A' THEN 'Didn''t vote' WHEN 'F' THEN 'Free vote' END, 'party', json_object('name', json_object('en', party.name_en), 'short_name', json_object('en', party.short_name_en))) ORDER BY pv.id) AS l
    FROM pv JOIN party ON party.id = pv.party_id GROUP BY votequestion_id) SELECT vq.id, CAST(json_object({_VOTE}, 'party_votes', pl.l) AS VARCHAR) AS json FROM vq LEFT JOIN bill b ON b.id = vq.bill_id LEFT JOIN pl ON pl.id = vq.id""")  # fmt: skip
def votes_detail(s, d):
    return rs.as_json(_vote_rows(s, d), "id", rs.vote_fields(True))


@query("k8_ballots", BASE + "SELECT mv.id, CAST(json_object('vote_url', '/votes/' || vq.session_id || '/' || CAST(vq.number AS VARCHAR) || '/', 'politician_url', '/politicians/' || pol.slug || '/', 'politician_membership_url', '/politicians/roles/' || CAST(mv.member_id AS VARCHAR) || '/', 'ballot', CASE mv.vote WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' WHEN 'P' THEN 'Paired' WHEN 'A' THEN 'Didn''t vote' END) AS VARCHAR) AS json FROM mv JOIN vq ON vq.id = mv.votequestion_id JOIN pol ON pol.id = mv.politician_id")
def ballots_json(s, d):
    q = questions(s, d).select(F.col("id").alias("votequestion_id"), tx.vote_url(F.col("session_id"), F.col("number")).alias("vote_url"))
    who = people(s, d).select(F.col("id").alias("politician_id"), tx.person_url(F.col("slug"), F.col("id")).alias("politician_url"))
    return rs.as_json(ballots(s, d).join(q, "votequestion_id").join(who, "politician_id"), "id", rs.ballot_fields())


_MEMBER = "'url', '/politicians/roles/' || CAST(em.id AS VARCHAR) || '/', 'start_date', CAST(start_date AS VARCHAR), 'end_date', CAST(end_date AS VARCHAR), 'party', json_object('name', json_object('en', party.name_en), 'short_name', json_object('en', party.short_name_en)), 'label', json_object('en', party.short_name_en || ' MP for Riding ' || CAST(riding_id AS VARCHAR)), 'riding', json_object('name', json_object('en', 'Riding ' || CAST(riding_id AS VARCHAR)), 'province', 'ON', 'id', riding_id)"


def _member_rows(s, d):
    p = table(s, d, "party").select(F.col("id").alias("party_id"), F.col("name_en").alias("party_en"), F.col("short_name_en").alias("party_short_en"))
    return members(s, d).join(F.broadcast(p), "party_id").withColumns({"riding_name": F.concat(F.lit("Riding "), F.col("riding_id").cast("string")), "riding_province": F.lit("ON")})  # fixed, 7 rows


@query("k8_memberships", BASE + f"SELECT em.id, CAST(json_object({_MEMBER}, 'politician_url', '/politicians/' || pol.slug || '/') AS VARCHAR) AS json FROM em JOIN party ON party.id = em.party_id JOIN pol ON pol.id = em.politician_id")
def memberships_json(s, d):
    who = people(s, d).select(F.col("id").alias("politician_id"), tx.person_url(F.col("slug"), F.col("id")).alias("politician_url"))
    return rs.as_json(_member_rows(s, d).join(who, "politician_id"), "id", rs.membership_fields())


@query("k8_people", BASE + f""", m AS (SELECT politician_id AS id, list(json_object({_MEMBER}) ORDER BY COALESCE(end_date, DATE '9999-12-31') DESC, start_date DESC NULLS LAST, em.id DESC) AS l FROM em JOIN party ON party.id = em.party_id GROUP BY politician_id)
    SELECT pol.id, CAST(json_object('name', name, 'given_name', name_given, 'family_name', name_family, 'gender', CASE gender WHEN 'M' THEN 'male' WHEN 'F' THEN 'female' ELSE '' END, 'memberships', COALESCE(m.l, [])) AS VARCHAR) AS json FROM pol LEFT JOIN m ON m.id = pol.id""")  # fmt: skip
def people_json(s, d):
    m = _member_rows(s, d).select("id", "politician_id", "start_date", "end_date", F.struct(*rs.membership_fields(True)).alias("m"))
    return rs.politician_detail(people(s, d), m)


@query("k8_statements", BASE + """SELECT st.id, CAST(json_object('time', strftime(time, '%Y-%m-%d %H:%M:%S'), 'attribution', json_object('en', who_en, 'fr', NULL), 'content', json_object('en', content_en, 'fr', content_fr), 'url', '/debates/' || CAST(document_id AS VARCHAR) || '/' || st.slug || '/',
    'politician_url', CASE WHEN pol.id IS NULL THEN NULL ELSE '/politicians/' || pol.slug || '/' END, 'politician_membership_url', CASE WHEN member_id IS NULL THEN NULL ELSE '/politicians/roles/' || CAST(member_id AS VARCHAR) || '/' END, 'procedural', procedural, 'source_id', source_id, 'document_url', '/debates/' || CAST(document_id AS VARCHAR) || '/') AS VARCHAR) AS json
    FROM st LEFT JOIN pol ON pol.id = st.politician_id WHERE feed <> 'live_captions'""")  # fmt: skip
def statements_json(s, d):
    who = people(s, d).select(F.col("id").alias("politician_id"), tx.person_url(F.col("slug"), F.col("id")).alias("politician_url"))
    st = statements(s, d, "time", "who_en", "content_en", "content_fr", "document_id", "slug", "politician_id", "member_id", "procedural", "source_id", "feed").filter("feed <> 'live_captions'")
    url = F.concat(F.lit("/debates/"), F.col("document_id").cast("string"), F.lit("/"), F.col("slug"), F.lit("/"))
    return rs.as_json(st.join(who, "politician_id", "left").withColumns({"url": url, "who_fr": F.lit(None).cast("string")}), "id", rs.statement_fields())


@query("k8_bills", MORE + """, u AS (SELECT bill_id AS id, list('/votes/' || session_id || '/' || CAST(number AS VARCHAR) || '/' ORDER BY '/votes/' || session_id || '/' || CAST(number AS VARCHAR) || '/') AS l FROM vq WHERE bill_id IS NOT NULL GROUP BY bill_id)
    SELECT bill.id, CAST(json_object('session', session, 'legisinfo_id', bill.id, 'introduced', CAST(introduced AS VARCHAR), 'name', json_object('en', NULL, 'fr', NULL), 'number', number, 'short_title', json_object('en', NULL, 'fr', NULL), 'home_chamber', 'House', 'law', status_code = 'RoyalAssentGiven',
    'sponsor_politician_url', '/politicians/' || CAST(sponsor_politician_id AS VARCHAR) || '/', 'sponsor_politician_membership_url', NULL, 'vote_urls', u.l, 'private_member_bill', bill.id * 12 >= 200, 'status_code', status_code,
    'status', json_object('en', CASE status_code WHEN 'RoyalAssentGiven' THEN 'Law (royal assent given)' WHEN 'HouseAt2ndReading' THEN 'Second reading (House)' WHEN 'BillNotActive' THEN 'Not active' ELSE 'Unknown' END)) AS VARCHAR) AS json FROM bill JOIN u ON u.id = bill.id""")  # fmt: skip
def bills_json(s, d):
    u = questions(s, d).filter("bill_id is not null").groupBy(F.col("bill_id").alias("id")).agg(F.sort_array(F.collect_list(tx.vote_url(F.col("session_id"), F.col("number")))).alias("vote_urls"))
    none = F.lit(None).cast("string")
    b = bl.computed(bills(s, d), F.lit("2018-01-01").cast("date")).join(u, "id").withColumns({
        "legisinfo_id": F.col("id"), "name_en": none, "name_fr": none, "short_title_en": none, "short_title_fr": none, "sponsor_member_id": F.lit(None).cast("long"),
        "sponsor_politician_url": tx.person_url(F.lit(""), F.col("sponsor_politician_id")),
    })
    return rs.as_json(b, "id", rs.bill_fields(True))


@query("k8_meetings", MORE + "SELECT id, CAST(json_object('content', json_object('date', CAST(date AS VARCHAR), 'number', number, 'in_camera', in_camera, 'has_evidence', true, 'committee_url', '/committees/' || committee || '/')) AS VARCHAR) AS json FROM meet WHERE date IS NOT NULL")
def meetings_json(s, d):
    m = meetings(s, d).filter("date is not null")
    return m.select("id", F.to_json(F.struct(F.struct(*rs.meeting_fields()).alias("content")), {"ignoreNullFields": "false"}).alias("json"))


@query("k8_debates", MORE + "SELECT id, CAST(json_object('date', CAST(date AS VARCHAR), 'number', number, 'most_frequent_word', json_object('en', NULL), 'source_id', NULL, 'source_url', NULL, 'session', '41-1', 'document_type', 'Debate') AS VARCHAR) AS json FROM deb")
def debates_json(s, d):
    none = F.lit(None).cast("string")
    return rs.as_json(debates(s, d).withColumns({"most_frequent_word": none, "source_id": none, "source_url": none, "session": F.lit("41-1")}), "id", rs.document_fields(True))


@query("k8_committees", "SELECT c.name, CAST(json_object('name', json_object('en', c.name, 'fr', NULL), 'short_name', json_object('en', upper(c.name), 'fr', NULL), 'slug', c.name, 'parent_url', NULL, 'sessions', c.l, 'subcommittees', []) AS VARCHAR) AS json FROM (SELECT source AS name, list(DISTINCT session_id ORDER BY session_id DESC) AS l FROM documents WHERE doc_kind = 'evidence' AND source IS NOT NULL GROUP BY source) c")
def committees_json(s, d):
    m = meetings(s, d).filter("committee is not null").groupBy(F.col("committee").alias("name")).agg(F.sort_array(F.collect_set("session"), asc=False).alias("sessions"))
    none = F.lit(None).cast("string")
    m = m.withColumns({"name_en": F.col("name"), "name_fr": none, "short_name_en": F.upper("name"), "short_name_fr": none, "slug": F.col("name"), "parent_url": none, "subcommittees": F.array().cast("array<string>")})
    return rs.as_json(m, "name", rs.committee_fields(True))


@query("k16_sitemap", MORE + "SELECT 'politician' AS kind, '/politicians/' || slug || '/' AS url, CAST(NULL AS DATE) AS changed FROM pol WHERE EXISTS (SELECT 1 FROM em WHERE em.politician_id = pol.id) UNION ALL SELECT 'hansard', '/debates/' || CAST(year(date) AS VARCHAR) || '/' || CAST(month(date) AS VARCHAR) || '/' || CAST(day(date) AS VARCHAR) || '/', date FROM deb UNION ALL SELECT 'bill', '/bills/' || session || '/' || number || '/', NULL FROM bill UNION ALL SELECT 'votequestion', '/votes/' || session_id || '/' || CAST(number AS VARCHAR) || '/', date FROM vq")
def sitemap(s, d):
    """Every address with the day it last changed, for the four kinds of page."""
    none = F.lit(None).cast("date")
    row = lambda df, kind, url, at: df.select(F.lit(kind).alias("kind"), url.alias("url"), at.alias("changed"))
    elected = people(s, d).join(members(s, d).select(F.col("politician_id").alias("id")), "id", "left_semi")
    got = row(elected, "politician", tx.person_url(F.col("slug"), F.col("id")), none).unionByName(row(debates(s, d), "hansard", tx.debate_url(F.col("date")), F.col("date")))
    got = got.unionByName(row(bills(s, d), "bill", tx.bill_url(F.col("session"), F.col("number")), none))
    return got.unionByName(row(votes(s, d), "votequestion", tx.vote_url(F.col("session"), F.col("number")), F.col("date")))


@query("flt_p24_legacy", BASE + """SELECT document_id, CAST(json_object('id', document_id, 'statements', list(json_object('url', '/s/' || CAST(st.id AS VARCHAR) || '/', 'heading', h1_en, 'topic', h2_en, 'time', strftime(time, '%Y-%m-%d %H:%M:%S'), 'attribution', who_en,
    'politician', CASE WHEN em.id IS NULL THEN NULL ELSE json_object('id', pol.id, 'member_id', em.id, 'name', pol.name, 'party', party.short_name_en) END) ORDER BY sequence)) AS VARCHAR) AS json
    FROM st LEFT JOIN em ON em.id = st.member_id LEFT JOIN pol ON pol.id = em.politician_id LEFT JOIN party ON party.id = em.party_id WHERE feed = 'gazette_txt' GROUP BY document_id""")  # fmt: skip
def legacy(s, d):
    """The sittings of one feed in the old interface's shape: a sitting is one row there by its definition."""
    p = table(s, d, "party").select(F.col("id").alias("party_id"), F.col("short_name_en").alias("party"))
    m = members(s, d).join(F.broadcast(p), "party_id", "left").join(people(s, d).select(F.col("id").alias("politician_id"), "name"), "politician_id", "left")  # fixed, 7 rows
    m = m.select(F.col("id").alias("member_id"), F.struct(F.col("politician_id").alias("id"), F.col("id").alias("member_id"), "name", "party").alias("politician"))
    st = statements(s, d, "document_id", "sequence", "h1_en", "h2_en", "time", "who_en", "member_id", "feed").filter("feed = 'gazette_txt'").join(m, "member_id", "left")
    one = F.struct(F.concat(F.lit("/s/"), F.col("id").cast("string"), F.lit("/")).alias("url"), F.col("h1_en").alias("heading"), F.col("h2_en").alias("topic"), F.col("time").cast("string").alias("time"), F.col("who_en").alias("attribution"), "politician")
    got = st.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence", one.alias("x")))), lambda e: e["x"]).alias("statements"))
    return rs.as_json(got, "document_id", [F.col("document_id").alias("id"), F.col("statements")])


QUERIES, ORACLE = REGISTRY.queries, REGISTRY.sql
