"""The readers over files made of the tables, compared with what was written into them (ids S6-S18, X, J11, J13, J14, J20, K13)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.catalog import once, table
from quorumlake.functions import text as tx
from quorumlake.plans.debates import SAID, _said
from quorumlake.plans.lists import MORE, bills
from quorumlake.plans.records import BASE, ballots, members, people, questions
from quorumlake.plans.registry import Registry
from quorumlake.session import shared_dir
from quorumlake.sources import files, pages, transcripts

REGISTRY = Registry()
query = REGISTRY.query


def _lines(lines: DataFrame, one_each: bool = False) -> str:
    """The single column of `lines` as text files; with `one_each` a file per row."""
    path = f"{shared_dir(lines.sparkSession)}/files-{uuid.uuid4().hex}"
    w = lines.write
    (w.option("maxRecordsPerFile", 1) if one_each else w).text(path)
    return path


def _arrays(rows: DataFrame, key: str, wrap: str = "{}") -> str:
    """Rows as JSON arrays of some hundred, a file each."""
    packed = rows.groupBy(F.floor(F.col(key) / 200).alias("_f")).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != key])).alias("a"))
    a, _, b = wrap.partition("{}")  # where the array stands
    return _lines(packed.select(F.concat(F.lit(a), F.to_json("a"), F.lit(b)).alias("value")), True)


def _elements(rows: DataFrame, key: str, root: str) -> str:
    """Elements (`x`) as XML documents of some hundred, a file each."""
    packed = rows.groupBy(F.floor(F.col(key) / 200).alias("_f")).agg(F.array_join(F.collect_list("x"), "").alias("x"))
    return _lines(packed.select(F.concat(F.lit(f"<{root}>"), "x", F.lit(f"</{root}>")).alias("value")), True)


# --- transcripts --------------------------------------------------------------------------------------------------------------


def _xml(s, d) -> DataFrame:
    """A document per sitting: each statement an intervention with one paragraph, under its headings."""
    st = _said(s, d, "h1_en", "h2_en", "who_hocid", "wordcount", "time")
    item = lambda n, v: F.concat(F.lit(f'<ExtractedItem Name="{n}">'), v.cast("string"), F.lit("</ExtractedItem>"))
    hoc = F.coalesce(F.concat(F.lit(' DbId="'), F.col("who_hocid").cast("string"), F.lit('"')), F.lit(""))
    one = F.concat(
        F.lit("<OrderOfBusiness><OrderOfBusinessTitle>"), tx.escaped(F.coalesce("h1_en", F.lit(""))), F.lit("</OrderOfBusinessTitle><SubjectOfBusiness><SubjectOfBusinessTitle>"),
        tx.escaped(F.coalesce("h2_en", F.lit(""))), F.lit('</SubjectOfBusinessTitle><SubjectOfBusinessContent><Timestamp Hr="'), F.hour("time").cast("string"), F.lit('" Mn="'),
        F.minute("time").cast("string"), F.lit('"/><Intervention id="s'), F.col("id").cast("string"), F.lit('" Type="Debate"><PersonSpeaking><Affiliation'), hoc, F.lit(">Person "),
        F.col("id").cast("string"), F.lit(':</Affiliation></PersonSpeaking><Content><ParaText id="'), F.col("id").cast("string"), F.lit('">Of <I>'), F.col("wordcount").cast("string"),
        F.lit(" words</I> &amp; more.</ParaText></Content></Intervention></SubjectOfBusinessContent></SubjectOfBusiness></OrderOfBusiness>"),
    )
    # A sitting is one file by its nature.
    body = st.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", one.alias("x")))), lambda e: e["x"]), "").alias("b"), F.min("time").alias("t"))
    head = F.concat(
        F.lit('<Hansard xml:lang="en" id="'), F.col("document_id").cast("string"), F.lit('"><ExtractedInformation>'), item("MetaDateNumYear", F.year("t")), item("MetaDateNumMonth", F.month("t")),
        item("MetaDateNumDay", F.dayofmonth("t")), item("ParliamentNumber", F.lit("41")), item("SessionNumber", F.lit("2")), item("MetaDocumentCategory", F.lit("Debates")),
        F.lit("</ExtractedInformation><HansardBody>"),
    )
    text = F.concat(head, "b", F.lit("</HansardBody></Hansard>"))
    return body.select(F.concat(F.lit("/d/"), F.col("document_id").cast("string")).alias("path"), F.encode(text, "UTF-8").alias("content"))


_HEAD = "CASE WHEN upper({0}) <> lower({0}) AND (upper({0}) = {0} OR lower({0}) = {0}) THEN array_to_string(list_transform(regexp_extract_all({0}, '\\p{{L}}+|\\P{{L}}+'), lambda x: upper(x[1]) || lower(x[2:])), '') ELSE {0} END"
_STATED = SAID + f""", p AS (SELECT *, COALESCE(trim(regexp_replace(h1_en, '\\s+', ' ', 'g')), '') AS a1, COALESCE(trim(regexp_replace(h2_en, '\\s+', ' ', 'g')), '') AS b2, min(CAST(time AS DATE)) OVER (PARTITION BY document_id) AS day FROM sd),
x AS (SELECT id, document_id, sequence, 's' || CAST(id AS VARCHAR) AS sid, 'Person ' || CAST(id AS VARCHAR) AS who, CAST(who_hocid AS VARCHAR) AS who_id, {_HEAD.format('a1')} AS h1, b2 AS h2, CAST(day AS TIMESTAMP) + to_minutes(CAST(60 * hour(time) + minute(time) AS BIGINT)) AS time,
  '<p data-HoCid="' || CAST(id AS VARCHAR) || '" data-originallang="en">Of <em>' || CAST(wordcount AS VARCHAR) || ' words</em> &amp; more.</p>' AS content FROM p) """


@query("s8_s9_x1_x10_transcripts", _STATED + "SELECT '/d/' || CAST(document_id AS VARCHAR) AS path, sid AS id, who, who_id, h1, h2, time, content, false AS procedural FROM x")
def read_transcripts(s, d):
    return transcripts.parsed(_xml(s, d)).select("path", "id", "who", "who_id", "h1", "h2", "time", "content", "procedural")


@query("k13_html", _STATED + """, e AS (SELECT *, '<div class="statement"' || CASE WHEN h1 <> '' THEN ' data-h1="' || replace(h1, '&', '&amp;') || '"' ELSE '' END || CASE WHEN h2 <> '' THEN ' data-h2="' || replace(h2, '&', '&amp;') || '"' ELSE '' END || ' data-intervention-type="debate"'
    || CASE WHEN who_id IS NULL THEN '' ELSE ' data-person-speaking-HoCid="' || who_id || '"' END || ' data-person-speaking-attribution="' || who || '" data-timestamp="' || strftime(time, '%Y-%m-%d %H:%M:%S') || '" id="' || sid || '">' || replace(content, '</p>', '</p>' || chr(10) || chr(9)) || '</div>' AS h FROM x)
    SELECT '/d/' || CAST(document_id AS VARCHAR) AS path, '<!DOCTYPE html>' || chr(10) || '<html><head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>House Debates, ' || CAST(min(CAST(time AS DATE)) AS VARCHAR) || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || string_agg(h, chr(10) ORDER BY sequence) || '</body></html>' AS html FROM e GROUP BY document_id""")  # fmt: skip
def html(s, d):
    return transcripts.as_html(transcripts.parsed(_xml(s, d)))


@query("g8_j12_new_documents", SAID + "SELECT DISTINCT '/d/' || CAST(document_id AS VARCHAR) AS path FROM sd WHERE document_id % 2 = 1")
def new_documents(s, d):
    """The documents of even numbers have been read before."""
    docs = _xml(s, d)
    stored = docs.filter(F.split_part("path", F.lit("/"), F.lit(3)).cast("long") % 2 == 0).select("path")
    return transcripts.new_documents(docs, stored).select("path")


def _two_languages(s, d):
    st = _said(s, d, "content_en").select(F.col("document_id").cast("string").alias("document"), F.col("id").cast("string").alias("id"), "sequence")
    p = lambda k: F.concat("id", F.lit(f"-{k}"))
    en = st.select("document", "id", F.array(p(1), p(2)).alias("pids"), F.concat(F.lit("one "), "id", F.lit("\ntwo "), "id").alias("content"))
    # In French a third has other ids, a third lacks its second paragraph.
    k = F.col("id").cast("long") % 3
    fr = st.select("document", F.when(k == 1, F.concat(F.lit("f"), "id")).otherwise(F.col("id")).alias("id"), F.when(k == 2, F.array(p(1))).otherwise(F.array(p(1), p(2))).alias("pids"),
                   F.when(k == 2, F.concat(F.lit("un "), "id")).otherwise(F.concat(F.lit("un "), "id", F.lit("\ndeux "), "id")).alias("content"))
    return en, fr


@query("j13_merged_languages", SAID + "SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 = 2 THEN NULL ELSE 'un ' || CAST(id AS VARCHAR) || chr(10) || 'deux ' || CAST(id AS VARCHAR) END AS content_fr FROM sd")
def merged(s, d):
    return transcripts.merge_languages(*_two_languages(s, d)).select("id", "content_fr")


@query("j14_x11_slugs", SAID + "SELECT CAST(document_id AS VARCHAR) AS document, 'old-' || CAST(id AS VARCHAR) AS old_slug, 'new-' || CAST(id AS VARCHAR) AS new_slug FROM sd WHERE id % 3 <> 0")
def slugs(s, d):
    """Where the old address of a statement leads: to the one that has its first paragraph; a third keeps its address."""
    en, _ = _two_languages(s, d)
    old = en.select("document", F.concat(F.lit("old-"), "id").alias("slug"), "pids")
    new = en.select("document", F.concat(F.when(F.col("id").cast("long") % 3 == 0, "old-").otherwise("new-"), "id").alias("slug"), "pids")
    return transcripts.slug_moves(old, new)


# --- records --------------------------------------------------------------------------------------------------------------------


@query("s7_fixtures", "SELECT CAST(id AS VARCHAR) AS pk, name_en, slug FROM party")
def fixtures(s, d):
    p = table(s, d, "party").select("id", F.lit("core.party").alias("model"), F.col("id").cast("string").alias("pk"), F.struct("name_en", "slug").alias("fields"))
    return files.fixtures(s, _arrays(p, "id"), "name_en string, slug string")


@query("s10_votes", BASE + "SELECT session_id, number, date, yea_total, nay_total, result, description_en AS description FROM vq")
def votes(s, d):
    q = questions(s, d)
    el = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    text = lambda c: F.col(c).cast("string")
    name = F.when(F.col("result") == "Y", "Agreed To").when(F.col("result") == "N", "Negatived").otherwise("Tie")
    x = F.concat(
        F.lit("<Vote>"), el("DecisionDivisionNumber", text("number")), el("ParliamentNumber", F.split_part("session_id", F.lit("-"), F.lit(1))), el("SessionNumber", F.split_part("session_id", F.lit("-"), F.lit(2))),
        el("DecisionEventDateTime", F.concat(text("date"), F.lit("T18:00:00"))), el("DecisionDivisionNumberOfYeas", text("yea_total")), el("DecisionDivisionNumberOfNays", text("nay_total")),
        el("DecisionResultName", name), el("DecisionDivisionSubject", tx.escaped(F.col("description_en"))), F.lit("</Vote>"),
    )
    return files.votes_xml(s, _elements(q.select("id", x.alias("x")), "id", "Votes")).select("session_id", "number", "date", "yea_total", "nay_total", "result", "description")


@query("s10_ballots", BASE + "SELECT politician_id AS person_id, CAST(votequestion_id AS VARCHAR) AS riding, CASE WHEN vote = 'A' THEN NULL ELSE vote END AS vote FROM mv")
def ballot_files(s, d):
    b = ballots(s, d)
    flag = lambda n, v: F.concat(F.lit(f"<{n}>"), F.when(F.col("vote") == v, "true").otherwise("false"), F.lit(f"</{n}>"))
    x = F.concat(F.lit("<VoteParticipant><PersonId>"), F.col("politician_id").cast("string"), F.lit("</PersonId><ConstituencyName>"), F.col("votequestion_id").cast("string"), F.lit("</ConstituencyName>"),
                 flag("IsVoteYea", "Y"), flag("IsVoteNay", "N"), flag("IsVotePaired", "P"), F.lit("</VoteParticipant>"))
    return files.ballots_xml(s, _elements(b.select("id", x.alias("x")), "id", "List")).select("person_id", F.col("riding").cast("string").alias("riding"), "vote")


@query("s11_n2_bills", MORE + ", t AS (SELECT bill_id AS id, max(docid) AS doc FROM bill_text GROUP BY bill_id) SELECT bill.id AS legisinfo_id, number, bill.id * 12 >= 200 AS privatemember, introduced, status_date, status_code = 'RoyalAssentGiven' AS law, t.doc AS text_docid FROM bill LEFT JOIN t ON t.id = bill.id")
def bill_files(s, d):
    """Two first readings of which the earlier counts, and publications of which the last does."""
    pubs = table(s, d, "bill_text").groupBy(F.col("bill_id").alias("id")).agg(F.transform(F.sort_array(F.collect_set("docid")), lambda x: F.struct(x.alias("PublicationId"))).alias("Publications"))
    stamp = lambda c: F.concat(c.cast("string"), F.lit("T10:00:00"))
    b = bills(s, d).join(pubs, "id", "left").select(
        F.col("id").alias("_key"), F.col("id").alias("Id"), F.col("number").alias("NumberCode"), F.when(F.col("law"), "Royal assent received").otherwise("x").alias("StatusName"), "Publications",
        stamp(F.date_add("introduced", 9)).alias("PassedHouseFirstReadingDateTime"), stamp(F.col("introduced")).alias("PassedSenateFirstReadingDateTime"), stamp(F.col("status_date")).alias("LatestBillEventDateTime"),
    )
    return files.bills_json(s, _arrays(b, "_key")).select("legisinfo_id", "number", "privatemember", "introduced", "status_date", "law", "text_docid")


@query("j11_similar_bills", BASE + ", b AS (SELECT DISTINCT bill_id AS id FROM vq WHERE bill_id IS NOT NULL), l AS (SELECT a.id AS x, b.id AS y FROM b a JOIN b ON b.id = a.id + 1) SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l")
def similar(s, d):
    """Every bill names the next number as similar, where there is one."""
    b = questions(s, d).filter("bill_id is not null").select(F.col("bill_id").alias("id")).distinct()
    nxt = b.select((F.col("id") - 1).alias("id"), F.array(F.struct(F.col("id").alias("Id"))).alias("SimilarBills"))
    return files.similar_bills(b.join(nxt, "id").select(F.col("id").alias("legisinfo_id"), "SimilarBills"))


@query("j20_bill_meetings", BASE + "SELECT id, '41-2' AS session_id, 'HEAL' AS acronym, CAST(number AS INTEGER) AS number FROM vq WHERE id % 2 = 0 UNION ALL SELECT id, '41-2', 'HEAL', CAST(number + 1 AS INTEGER) FROM vq WHERE id % 2 = 0")
def bill_meetings(s, d):
    """Stages of which the first has no meetings, and a meeting of another committee in the second."""
    m = lambda a, n: F.struct(F.lit(a).alias("CommitteeAcronym"), n.cast("int").alias("Number"))
    none = F.array().cast("array<struct<CommitteeAcronym: string, Number: int>>")
    stage = lambda x: F.struct(F.lit(41).alias("ParliamentNumber"), F.lit(2).alias("SessionNumber"), x.alias("CommitteeMeetings"))
    n = F.col("number")
    second = F.when(F.col("id") % 2 == 0, F.array(m("HEAL", n), m("FINA", n), m("HEAL", n + 1))).otherwise(none)
    q = questions(s, d).select("id", F.to_json(F.struct(F.array(stage(none), stage(second)).alias("HouseBillStages"))).alias("stages"))
    return files.committee_meetings(q, "id", "stages")


@query("s12_j21_elections", BASE + "SELECT riding_id AS district, CAST(id AS VARCHAR) AS family, CAST(party_id AS VARCHAR) AS party, CAST(id * 10 AS INTEGER) AS votes FROM em WHERE riding_id IS NOT NULL AND (id % 2 = 0 OR riding_id NOT IN (SELECT riding_id FROM em WHERE id % 2 = 0 AND riding_id IS NOT NULL))")
def elections(s, d):
    """Results of even numbers are validated and beat the preliminary ones of their district; other lines are passed over."""
    m = members(s, d).filter("riding_id is not null")
    kind = F.when(F.col("id") % 2 == 0, "validated").otherwise("preliminary")
    t = lambda c: F.col(c).cast("string")
    row = F.concat_ws("\t", t("riding_id"), F.lit("a"), F.lit("b"), kind, F.lit("x"), t("id"), F.lit("x"), F.lit("G"), F.coalesce(t("party_id"), F.lit("")), F.lit("x"), (F.col("id") * 10).cast("string"), F.lit("1.5"))
    lines = m.select(F.explode(F.array(row, F.concat(F.lit("note "), row))).alias("value"))
    return files.election_results(s, _lines(lines)).select("district", "family", F.col("party"), "votes")


@query("s13_members", BASE + "SELECT name, 'p' || CAST(id AS VARCHAR) AS email, CASE WHEN id % 3 = 0 THEN NULL ELSE 'legislature' END AS type FROM pol UNION ALL SELECT name, 'p' || CAST(id AS VARCHAR), 'constituency' FROM pol WHERE id % 3 = 1")
def member_files(s, d):
    """Of three people one has no office, one has one, one has two."""
    office = lambda t: F.struct(F.lit(t).alias("type"))
    none = F.array().cast("array<struct<type: string>>")
    k = F.col("id") % 3
    offices = F.when(k == 0, none).when(k == 1, F.array(office("legislature"), office("constituency"))).otherwise(F.array(office("legislature")))
    p = people(s, d).select("id", "name", F.concat(F.lit("p"), F.col("id").cast("string")).alias("email"), offices.alias("offices"))
    return files.members_json(s, _arrays(p, "id", '{"objects": {}}')).select("name", "email", "type")


@query("s14_ridings", BASE + "SELECT DISTINCT CAST(35000 + riding_id AS INTEGER) AS edid, 'Riding ' || CAST(riding_id AS VARCHAR) AS name_en, 'ON' AS province FROM em WHERE riding_id IS NOT NULL")
def riding_files(s, d):
    r = members(s, d).filter("riding_id is not null").select("riding_id").distinct()
    meta = F.struct(F.concat(F.lit("Riding "), F.col("riding_id").cast("string")).alias("ED_NAMEE"), F.lit("ON").alias("PROVCODE"))
    rows = r.select(F.col("riding_id").cast("long").alias("_key"), (F.col("riding_id") + 35000).cast("string").alias("external_id"), meta.alias("metadata"))
    return files.ridings_json(s, _arrays(rows, "_key", '{"objects": {}}')).select("edid", "name_en", "province")


@query("s15_s16_tiles", BASE + "SELECT '/m/' || slug AS link, trim(name) AS name, CAST(id AS VARCHAR) AS riding FROM pol")
def tile_pages(s, d):
    tile = F.concat(F.lit('<div class="tile big"><a href="/m/'), "slug", F.lit('"><span class="name"> '), tx.escaped(F.col("name")), F.lit(' </span></a><br><p class="riding">'), F.col("id").cast("string"), F.lit("</p></div>"))
    page = people(s, d).select(F.concat(F.lit("<html><p>no</p>"), tile, F.lit("</html>")).alias("page"))
    return pages.tiles(page, "page", "tile", {"name": "name", "riding": "riding"})


@query("s17_bill_texts", r"SELECT '/b/' || CAST(id AS VARCHAR) AS path, trim(regexp_replace(b, '\s+', ' ', 'g')) AS body, NULLIF(trim(regexp_replace(u, '\s+', ' ', 'g')), '') AS summary FROM (SELECT id, any_value(text_en) AS b, any_value(summary_en) AS u FROM bill_text GROUP BY id)")
def bill_text_files(s, d):
    b = once(table(s, d, "bill_text").select("id", "text_en", "summary_en"), "id")
    summary = F.when(F.col("summary_en") != "", F.concat(F.lit("<Summary>"), tx.escaped(F.col("summary_en")), F.lit("</Summary>"))).otherwise("")
    x = F.concat(F.lit("<Bill>"), summary, F.lit("<Body>"), tx.escaped(F.col("text_en")), F.lit("</Body></Bill>"))
    return pages.bill_parts_of(b.select(F.concat(F.lit("/b/"), F.col("id").cast("string")).alias("path"), F.encode(x, "UTF-8").alias("content"))).select("path", "body", "summary")


@query("s18_a5_next_sitting", BASE + "SELECT session_id, max(CASE WHEN id % 5 = 0 THEN NULL ELSE number END) + 1 AS next FROM vq GROUP BY session_id")
def next_sitting(s, d):
    """Every fifth number has a letter and doesn't count."""
    q = questions(s, d).withColumn("n", F.concat(F.col("number").cast("string"), F.when(F.col("id") % 5 == 0, "-B").otherwise("")))
    return pages.next_sitting(q, "n", "session_id")


QUERIES, ORACLE = REGISTRY.queries, REGISTRY.sql
