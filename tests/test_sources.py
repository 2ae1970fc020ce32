"""Readers on tiny files."""

import datetime as dt
import json

import pytest

from quorumlake.sources import files, transcripts

XML = """<?xml version="1.0"?>
<Hansard xml:lang="en" id="77"><ExtractedInformation>
<ExtractedItem Name="MetaDateNumYear">2020</ExtractedItem><ExtractedItem Name="MetaDateNumMonth">3</ExtractedItem><ExtractedItem Name="MetaDateNumDay">9</ExtractedItem>
<ExtractedItem Name="ParliamentNumber">43</ExtractedItem><ExtractedItem Name="SessionNumber">1</ExtractedItem><ExtractedItem Name="Number">Number 012</ExtractedItem>
</ExtractedInformation><HansardBody>
<OrderOfBusiness><OrderOfBusinessTitle>Routine  Business</OrderOfBusinessTitle>
<SubjectOfBusiness><SubjectOfBusinessTitle>Harbours</SubjectOfBusinessTitle><SubjectOfBusinessContent>
<Timestamp Hr="24" Mn="5"/><FloorLanguage language="FR"/>
<Intervention id="a1" Type="Debate"><PersonSpeaking><Affiliation DbId="5" Type="2">Hon. Ann Lee (North Bay):</Affiliation></PersonSpeaking><Content>
<ParaText id="p1">Mr. Speaker, <I>well</I> &lt; said.</ParaText><ParaText id="p2">Second.</ParaText></Content></Intervention>
<Intervention id="a2" Type="Debate"><PersonSpeaking><Affiliation DbId="5" Type="2">Hon. Ann Lee</Affiliation></PersonSpeaking><Content><ParaText id="p3">Same again.</ParaText></Content></Intervention>
<Intervention id="a3"><PersonSpeaking><Affiliation DbId="9" Type="28">Mr. Bo Reed</Affiliation></PersonSpeaking><Content><FloorLanguage language="EN"/><ParaText id="p4">No.</ParaText></Content></Intervention>
<ProceduralText id="p5">(Motion agreed to)</ProceduralText>
</SubjectOfBusinessContent></SubjectOfBusiness>
<SubjectOfBusiness><SubjectOfBusinessTitle>Fish</SubjectOfBusinessTitle><SubjectOfBusinessContent><ParaText id="p6">Nobody named.</ParaText></SubjectOfBusinessContent></SubjectOfBusiness>
</OrderOfBusiness></HansardBody></Hansard>"""


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.xml").write_text("<Hansard><open>")
    (tmp_path / "c.xml").write_text("no xml")
    rows = transcripts.transcripts(spark, str(tmp_path)).orderBy("path", "seq").collect()
    good = [r for r in rows if r.error is None]
    assert len(rows) - len(good) == 2 and [r.id for r in good] == ["a1", "a2", "a3", "pp5"]
    a, a2, b, c = good
    assert a.date == dt.date(2020, 3, 9) and a.session_id == "43-1" and a.number == "12" and a.time == dt.datetime(2020, 3, 10, 0, 5)
    assert (a.h1, a.h2, a.who, a.who_id) == ("Routine Business", "Harbours", "Hon. Ann Lee (North Bay)", "5")
    assert a.pids == ["p1", "p2"] and a2.pids == ["p3"] and not a.procedural and (a.context, a2.context, a.kind) == ("North Bay", "North Bay", "debate")
    assert a.content.split("\n")[0] == '<p data-HoCid="p1" data-originallang="fr">Mr. Speaker, <em>well</em> &lt; said.</p>'
    assert b.role == "witness" and c.content.startswith('<p class="procedural" data-HoCid="p5">(Motion agreed to)</p>') and c.procedural
    assert (c.who, c.h2, c.pids) == ("", "Harbours", ["p5", "p6"])
    page = transcripts.as_html(transcripts.transcripts(spark, str(tmp_path))).collect()
    assert len(page) == 1 and '<div class="statement" data-h1="Routine Business" data-h2="Harbours" data-intervention-type="debate" data-person-speaking-HoCid="5"' in page[0].html


RULES = """<Hansard xml:lang="en" id="8"><ExtractedInformation><ExtractedItem Name="MetaDateNumYear">2021</ExtractedItem><ExtractedItem Name="MetaDateNumMonth">5</ExtractedItem>
<ExtractedItem Name="MetaDateNumDay">3</ExtractedItem><ExtractedItem Name="ParliamentNumber">45</ExtractedItem><ExtractedItem Name="SessionNumber">1</ExtractedItem></ExtractedInformation><HansardBody>
<Intro><ParaText id="1">The House met at 2:30 p.m.</ParaText><Prayer>Not said</Prayer></Intro>
<OrderOfBusiness><OrderOfBusinessTitle>GOVERNMENT ORDERS</OrderOfBusinessTitle><CatchLine>Orders</CatchLine>
<SubjectOfBusiness><SubjectOfBusinessTitle>Ships Act</SubjectOfBusinessTitle><ProceduralText TocType="TPC">Bill C-7. Second reading</ProceduralText><SubjectOfBusinessContent>
<Intervention id="i1" Type="Debate"><PersonSpeaking><Affiliation DbId="5" Type="2">Hon. Ann Lee (Bay, HDU)</Affiliation>:</PersonSpeaking><Content>
<ParaText id="2">moved that Bill C-7 be read.</ParaText><ParaText id="3">She said: It is time.</ParaText>
<ParaText id="4"><B>Some hon. members:</B> Hear, hear!</ParaText><ParaText id="5">I go on, <Motion>as <Query>asked</Query></Motion> on <Date>Monday</Date>.</ParaText>
<ParaText id="6"><B>Ms. Eva Reed</B>: No.</ParaText><ParaText id="7">Still no.</ParaText><ParaText id="8"><QuotePara>A quote.</QuotePara></ParaText><ParaText id="9"><QuotePara>More.</QuotePara></ParaText>
<ParaText id="10">See <Affiliation DbId="9">Mr. Oak</Affiliation> and <Document DbId="77">C-7</Document>.</ParaText></Content></Intervention>
<ProceduralText TocType="TPC">Report stage</ProceduralText><ProceduralText TocType="TPC">Amendment negatived</ProceduralText>
<Intervention id="i2"><PersonSpeaking><Affiliation>Ms. Eva Reed</Affiliation></PersonSpeaking><Content><Timestamp Hr="15" Mn="10"/><FloorLanguage language="UK"/><ParaText id="11">Third.</ParaText><Division DivisionNumber="4" id="d4"/></Content></Intervention>
</SubjectOfBusinessContent></SubjectOfBusiness>
<SubjectOfBusiness><SubjectOfBusinessTitle>Speech from the Throne</SubjectOfBusinessTitle><SubjectOfBusinessContent><ParaText id="12">Honourable members.</ParaText></SubjectOfBusinessContent></SubjectOfBusiness>
</OrderOfBusiness>
<OrderOfBusiness><OrderOfBusinessTitle>Questions</OrderOfBusinessTitle><WrittenQuestionResponse><QuestionID>Question No. 5--</QuestionID>
<Questioner><Affiliation DbId="5">Hon. Ann Lee</Affiliation></Questioner><QuestionContent><ParaText id="13">How many?</ParaText></QuestionContent>
<Responder><Affiliation DbId="8">Mr. Bo Oak</Affiliation></Responder><ResponseContent><ParaText id="14">Ten.</ParaText></ResponseContent></WrittenQuestionResponse></OrderOfBusiness>
</HansardBody></Hansard>"""


def test_rules_of_paragraphs():
    got = transcripts.parse(RULES.encode())
    assert [r["error"] for r in got] == [None] * len(got)
    seen = [(r["id"], r["who"], r["pids"]) for r in got]
    assert seen == [
        ("i1", "Hon. Ann Lee (Bay, HDU)", ["2", "3"]), ("p4", "Some hon. members", ["4"]), ("p5", "Hon. Ann Lee (Bay, HDU)", ["5"]), ("p6", "Ms. Eva Reed", ["6", "7", "8", "9", "10"]),
        ("i2", "Ms. Eva Reed", ["11"]), ("p12", "King Charles III", ["12"]), ("p13", "Hon. Ann Lee", ["13"]), ("p14", "Mr. Bo Oak", ["14"]),
    ]
    first, crowd, back, reed, third, throne, q, a = got
    assert first["time"] == dt.datetime(2021, 5, 3, 14, 30) and third["time"] == dt.datetime(2021, 5, 3, 15, 10)
    assert (first["h1"], first["h2"], first["bill"], first["stage"], third["stage"]) == ("Government Orders", "Ships Act", "C-7", "2", "report")
    assert '<p class="procedural" data-HoCid="2">moved that' in first["content"] and '<p data-HoCid="3" data-originallang="en">It is time.</p>' in first["content"]
    assert back["content"].endswith("I go on, as asked on Monday.</p>") and back["who_id"] == "5"
    assert '<blockquote><p data-HoCid="8" data-originallang="en">A quote.</p>\n<p data-HoCid="9" data-originallang="en">More.</p></blockquote>' in reed["content"] and "No.</p>" in reed["content"]
    assert 'class="related_link politician" data-HoCid="9"' in reed["content"] and 'class="related_link legislation" data-HoCid="77"' in reed["content"]
    assert '<p data-HoCid="11">Third.</p>' in third["content"] and "Vote #4</a></p>" in third["content"]
    assert (q["written"], a["written"], q["h2"], a["h2"], q["context"]) == ("Q", "R", "Question No. 5", "Question No. 5", "Bay, HDU")
    assert "unknown element Xyz" in transcripts.parse(RULES.replace("<Prayer>", "<Xyz/><Prayer>").encode())[0]["error"]


def test_merge_and_slugs(spark):
    s = "document string, id string, pids array<string>, content string"
    en = spark.createDataFrame([("d", "1", ["a", "b"], "A\nB"), ("d", "2", ["c"], "C"), ("d", "3", ["x"], "X")], s)
    fr = spark.createDataFrame([("d", "1", ["a", "b"], "fA\nfB"), ("d", "9", ["c", "d"], "fC\nfD")], s)
    got = {r.id: r.content_fr for r in transcripts.merge_languages(en, fr).collect()}
    assert got == {"1": "fA\nfB", "2": "fC", "3": None}
    o = spark.createDataFrame([("d", "lee-1", ["a", "b"]), ("d", "lee-2", ["c"]), ("d", "gone", ["z"])], "document string, slug string, pids array<string>")
    n = spark.createDataFrame([("d", "lee-2", 1, ["b"]), ("d", "lee-3", 2, ["c"])], "document string, slug string, seq int, pids array<string>")
    assert {(r.old_slug, r.new_slug) for r in transcripts.slug_moves(o, n).collect()} == {("lee-1", "lee-2"), ("lee-2", "lee-3")}
    assert sorted(r.slug for r in transcripts.free_slugs(n, o).collect()) == ["lee-2-a", "lee-3"]


def test_small_readers(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("head\tx\n10\ta\tb\tpreliminary\tx\tLee\tx\tAnn\tP\tx\t100\t50.5\n10\ta\tb\tvalidated\tx\tLee\tx\tAnn\tP\tx\t101\t50.6\n11\ta\tb\tpreliminary\tx\tReed\tx\tBo\tQ\tx\tn/a\t\n")
    got = {r.district: (r.votes, r.kind) for r in files.election_results(spark, str(tmp_path / "e.tsv")).collect()}
    assert got == {10: (101, "validated"), 11: (None, "preliminary")}
    (tmp_path / "f.json").write_text(json.dumps([{"model": "core.party", "pk": 3, "fields": {"name_en": "X", "slug": "x"}}]))
    assert files.fixtures(spark, str(tmp_path / "f.json"), "name_en string, slug string").collect()[0].asDict() == {"pk": "3", "name_en": "X", "slug": "x"}
    (tmp_path / "m.json").write_text(json.dumps({"objects": [{"name": "A", "offices": [{"type": "legislature", "tel": "1"}, {"type": "constituency"}]}, {"name": "B", "offices": []}]}))
    assert sorted((r.name, r.type) for r in files.members_json(spark, str(tmp_path / "m.json")).collect() if r.type) == [("A", "constituency"), ("A", "legislature")]
    assert files.members_json(spark, str(tmp_path / "m.json")).count() == 3
    (tmp_path / "r.json").write_text(json.dumps({"objects": [{"external_id": "35001", "metadata": {"ED_NAMEE": "N", "ED_NAMEF": "F", "PROVCODE": "ON"}}]}))
    assert files.ridings_json(spark, str(tmp_path / "r.json")).first().edid == 35001
    (tmp_path / "v.xml").write_text("<Votes><Vote><DecisionDivisionNumber>4</DecisionDivisionNumber><ParliamentNumber>43</ParliamentNumber><SessionNumber>1</SessionNumber><DecisionEventDateTime>2020-03-09T18:00:00</DecisionEventDateTime><DecisionResultName>Agreed To</DecisionResultName></Vote></Votes>")
    v = files.votes_xml(spark, str(tmp_path / "v.xml")).first()
    assert (v.session_id, v.number, v.date, v.result) == ("43-1", 4, dt.date(2020, 3, 9), "Y")
    (tmp_path / "p.xml").write_text("<L><VoteParticipant><PersonId>8</PersonId><IsVoteYea>true</IsVoteYea><IsVoteNay>false</IsVoteNay><IsVotePaired>false</IsVotePaired></VoteParticipant></L>")
    assert files.ballots_xml(spark, str(tmp_path / "p.xml")).first().vote == "Y"
    (tmp_path / "b.json").write_text(json.dumps([{"Id": 1, "NumberCode": "C-204", "PassedSenateFirstReadingDateTime": "2020-02-01T00:00:00", "Publications": [{"PublicationId": 5}, {"PublicationId": 6}], "SimilarBills": [{"Id": 2}]},
                                                 {"Id": 2, "NumberCode": "S-3", "Publications": [], "SimilarBills": [{"Id": 1}]}]))
    b = files.bills_json(spark, str(tmp_path / "b.json")).orderBy("legisinfo_id")
    r = b.first()
    assert (r.institution, r.number_only, r.privatemember, r.introduced, r.text_docid) == ("C", 204, True, dt.date(2020, 2, 1), 6)
    assert {tuple(x) for x in files.similar_bills(b).collect()} == {(1, 2), (2, 1)}
    st = json.dumps({"HouseBillStages": [{"CommitteeMeetings": []}, {"ParliamentNumber": 43, "SessionNumber": 1, "CommitteeMeetings": [{"CommitteeAcronym": "FISH", "Number": 2}, {"CommitteeAcronym": "X", "Number": 3}]}]})
    m = files.committee_meetings(spark.createDataFrame([(1, st), (2, "{}"), (3, None)], "id int, st string"), "id", "st").collect()
    assert [tuple(x) for x in m] == [(1, "43-1", "FISH", 2)]


@pytest.mark.parametrize("text,words", [("a — b", ["a", "b"]), ("— x", ["", "x"]), ("Don’t, stop-it!", ["don’t", "stop-it"])])
def test_tokens(spark, text, words):
    from pyspark.sql import functions as F

    from quorumlake.functions.text import ngrams, words_of

    df = spark.createDataFrame([(text,)], "t string").select(words_of(F.col("t")).alias("w"))
    assert df.first().w == words
    assert df.select(ngrams(F.col("w"), 5).alias("g")).first().g == []
    assert df.select(ngrams(F.col("w"), 2).alias("g")).first().g == [" ".join(words[i : i + 2]) for i in range(len(words) - 1)]
