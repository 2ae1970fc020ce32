"""Operators on small cases that pin what the tables don't show."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quorumlake.functions import dates, text
from quorumlake.operators import debates, filters, joins, language, ranking, runs, search, votes
from quorumlake.plans import more
from quorumlake.streaming import jobs


def test_party_line_ties_and_freedom(spark):
    b = spark.createDataFrame(
        [(1, 1, x) for x in "YYNN"] + [(1, 2, x) for x in "AAY"] + [(1, 3, "P")] + [(2, 1, x) for x in "Y" * 17 + "NNN"] + [(2, 2, x) for x in "Y" * 6 + "N"] + [(3, 9, "Y"), (None, 1, "Y"), (3, None, "Y"), (3, 9, None)],
        "vote_id int, party_id int, ballot string",
    )
    got = {(r.vote_id, r.party_id): (r.vote, round(r.disagreement, 3)) for r in votes.party_lines(b, independent=9).collect()}
    assert got == {(1, 1): ("F", 0.5), (1, 2): ("A", 0.0), (1, 3): ("P", 0.0), (2, 1): ("F", 0.15), (2, 2): ("Y", 0.143)}
    flags = votes.dissents(b.filter("vote_id = 2"), votes.party_lines(b, 9))
    assert flags.filter("dissent").count() == 1


def test_in_range_without_key(spark):
    pts = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (2, dt.date(2021, 6, 1)), (3, None), (4, dt.date(1990, 1, 1))], "i int, d date")
    rng = spark.createDataFrame([("a", dt.date(2019, 1, 1), dt.date(2020, 1, 1)), ("b", dt.date(2020, 1, 1), None), ("c", None, None)], "r string, s date, e date")
    got = sorted((r.i, r.r) for r in joins.in_range(pts, rng, "d", "s", "e", bucket_days=30).collect())
    assert got == [(1, "a"), (1, "b"), (2, "b")]
    assert joins.in_range(pts, rng, "d", "s", "e", how="left").count() == 5


def test_cascade_and_links(spark):
    asked = spark.createDataFrame([(1, "Ann Lee", "Lee"), (2, "A. Lee", "Lee"), (3, "Bo Reed", "Reed"), (4, "X", "X")], "id int, name string, fam string")
    people = spark.createDataFrame([("Ann Lee", "Lee", 10), ("Eva Lee", "Lee", 11), ("Bob Reed", "Reed", 12)], "name string, fam string, pid int")
    got = {r.id: (r.stage, r.candidates, r.pid) for r in joins.first_match(asked, "id", [(people, ["name"]), (people, ["fam"])], "pid").collect()}
    assert got == {1: (0, 1, 10), 2: (1, 2, None), 3: (1, 1, 12), 4: (None, None, None)}
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x")], "f string, t string")
    start = spark.createDataFrame([("a",), ("c",), ("x",)], "f string")
    assert {(r.f, r.target) for r in joins.follow(start, links, "f", "t").collect()} == {("a", "c"), ("c", "c"), ("x", "x")}


def test_shares_and_winners(spark):
    df = spark.createDataFrame([(1, "r", 2), (2, "r", 1), (3, "r", 2), (4, "s", 0), (5, "s", None), (6, "t", None)], "c int, riding string, v int")
    s = {r.c: r.p for r in ranking.share_of_group(df, ["riding"], "v", "p").collect()}
    assert float(s[1]) == 40.0 and s[4] is None and s[6] is None
    w = {r.c: r.w for r in ranking.winners(df, ["riding"], "v", "c", "w").collect()}
    assert w == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}


def test_scans_in_chunks_equal_plain_scans(spark):
    import random

    rng = random.Random(4)
    rows = [(g, i, i // 5, rng.choice(["a", "b", None])) for g in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, i int, chunk int, v string")
    for f, out in ((runs.fill_forward, "o"), (runs.run_numbers, "o")):
        plain = {(r.g, r.i): r.o for r in f(df, ["g"], ["i"], "v", out).collect()}
        assert {(r.g, r.i): r.o for r in f(df, ["g"], ["i"], "v", out, "chunk").collect()} == plain
    assert runs.run_numbers(df.limit(0), ["g"], ["i"], "v", "o", "chunk").count() == 0


def test_long_speeches(spark):
    rows = [(1, 1, 7, 300), (1, 3, 7, 300), (1, 4, 8, 900), (1, 9, 8, 10), (1, 10, None, 300), (1, 11, None, 300), (1, 12, 5, 999)]
    df = spark.createDataFrame(rows, "document_id int, sequence int, member int, wordcount int")
    got = sorted((r.member or 0, r.first_seq, r.words) for r in debates.long_speeches(df).collect())
    assert got == [(0, 10, 600), (7, 1, 600), (8, 4, 900)]
    assert debates.long_speeches(df, flush=True).count() == 4


def _fold(rows):
    """Sections of one document, row by row against the first statement of the open section."""
    special = {"oral questions", "oral question period", "statements by members", "adjournment proceedings"}
    runs = []
    for r in rows:
        if runs and r["h2"].lower().startswith("questions "):
            continue
        f = runs[-1][0] if runs else None
        if f and (all(r[k] == f[k] for k in ("h1", "h2", "h3", "bill")) or r["h1"] == f["h1"] and r["h1"].lower() in special or r["h1"] == f["h1"] and r["h2"] == f["h2"] and r["h2"] in "Petitions"):
            runs[-1].append(r)
        else:
            runs.append([r])
    words = lambda run: sum(r["wordcount"] for r in run if not r["procedural"])
    out = {}
    for run in runs:
        if not words(run):
            continue
        f = run[0]
        key = (f["bill"], f["stage"]) if f["bill"] else (f["h1"].lower(), f["h2"].lower(), f["h3"].lower())
        minutes = (run[-1]["time"] - f["time"]).seconds // 60
        if key in out:
            o = out[key]
            o["segments"] += f["sequence"] - o["all"][-1]["sequence"] > 5 and f["time"] != o["all"][-1]["time"]
            o["minutes"] += minutes
            o["all"] += run
        else:
            out[key] = {"all": list(run), "minutes": minutes, "segments": 1}
    kept = [o for o in out.values() if o["all"][0]["stage"] == "1" or words(o["all"]) >= 500 or max(r["wordcount"] for r in o["all"]) >= 300]
    return {(o["all"][0]["sequence"], words(o["all"]), len(o["all"]), o["minutes"], o["segments"]) for o in kept}


def test_sections(spark):
    rng = random.Random(4)
    t = lambda m: dt.datetime(2020, 1, 1, 10, 0) + dt.timedelta(minutes=m)
    cols = "document_id int, sequence int, time timestamp_ntz, slug string, h1 string, h2 string, h3 string, bill string, stage string, wordcount int, procedural boolean"
    heads = [("Oral Questions", "Fish", ""), ("Oral Questions", "Ships", ""), ("Routine Proceedings", "Petitions", "Fish"), ("Routine Proceedings", "Petitions", "Ships"), ("Routine Proceedings", "", ""),
             ("Orders", "Questions on the Order Paper", ""), ("Orders", "Ships Act", ""), ("ORDERS", "Ships Act", ""), ("Statements by Members", "", "")]
    docs = []
    for doc in range(40):
        clock = 0
        for k in range(rng.randint(1, 30)):
            h = rng.choice(heads)
            bill = ("C-1", rng.choice("12")) if h[1] == "Ships Act" and rng.random() < 0.5 else (None, "")
            clock += rng.choice([0, 0, 3, 700])
            for j in range(rng.randint(1, 3)):
                docs.append((doc, len(docs), t(clock + j), f"s{len(docs)}", *h, *bill, rng.choice([0, 20, 90, 250, 310]), rng.random() < 0.2))
    df = spark.createDataFrame(docs, cols)
    names = [c.split()[0] for c in cols.split(", ")]
    by = {}
    for r in docs:
        by.setdefault(r[0], []).append(dict(zip(names, r)))
    want = {(d, *x) for d, rows in by.items() for x in _fold(rows)}
    for chunk in (1000, 4):
        got = debates.sections(df.repartition(5), chunk)
        assert {(r.document_id, r.first_seq, r.words, r.statements, r.minutes, r.segments) for r in got.collect()} == want and len(want) > 40
    shown = {r.display_heading for r in got.collect()}
    assert {"Question Period", "Statements by Members", "Ships Act"} <= shown
    assert {r.heading for r in debates.subheads(df, got).collect()} <= {"Fish", "Ships"}
    assert debates.sections(df.limit(0)).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", True, None), (2, "b", False, dt.date(2020, 1, 1))], "id int, s string, b boolean, d date")
    r = filters.Resource(df, {"b": filters.ByColumn("b"), "d": filters.ByColumn("d", filters.NUMBERS), "s": filters.ByChoice("s", {"a": "Alpha"}), "f": filters.ByFunction(lambda x, v: x.limit(0))}, (F.col("id"),))
    ids = lambda p: [x.id for x in r.query(p).collect()]
    assert ids({"b": "True"}) == [1] and ids({"d": "none"}) == [1] and ids({"d__isnull": "false"}) == [2] and ids({"s": "Alpha"}) == [1]
    assert ids({"d__gte": "2019-01-01", "zz": "1", "b": ""}) == [2] and ids({"f": "1"}) == []
    for bad in ({"b__gt": "1"}, {"s": "zz"}, {"d__range": "2020-01-01"}):
        with pytest.raises(filters.BadRequest):
            r.query(bad)
    with pytest.raises(filters.BadRequest):
        r.page({"limit": "-1"})
    assert r.page({"limit": "9999"})[1] == 500 and r.page({"limit": "0"})[1] == 20
    assert [x.id for x in r.page({"limit": "1"})[0].collect()] == [1, 2]


def test_search_grammar():
    a = search.parse('MP: "x y"  ships   MP: "z" Foo: "k"', {"MP"})
    assert a.filters == {"MP": "z"} and a.text == 'ships Foo: "k"' and a.canonical() == 'ships Foo: "k" MP: "z"'


def test_dates(spark):
    r = spark.createDataFrame([("2020-2",), ("2019-11-30 to 2020-2",), ("2020-1-5",)], "t string").select(dates.month_range(F.col("t")).alias("r")).collect()
    T = dt.datetime
    assert [(x.r.lo, x.r.hi) for x in r] == [(T(2020, 2, 1), T(2020, 3, 1, 0, 1, 1)), (T(2019, 11, 30), T(2020, 3, 1, 0, 1, 1)), (T(2020, 1, 5), T(2020, 1, 6, 0, 1, 1))]
    c = spark.range(1).select(dates.clock(F.lit("2020-01-31").cast("date"), F.lit(25), F.lit(10)).alias("c"), dates.hour24(F.lit(12), F.lit("noon")).alias("n"), dates.hour24(F.lit(3), F.lit("p.m.")).alias("p")).first()
    assert c.c == T(2020, 2, 1, 1, 10) and (c.n, c.p) == (12, 15)


def test_text(spark):
    for n in (0, 63, 64, -5, 10**12):
        assert text.text_to_int64(text.int64_to_text(n)) == n
    df = spark.createDataFrame([("Élan d’Étoile", "<p>a<br>b &amp; c</p>", 70)], "t string, h string, n long")
    r = df.select(
        text.remove_accents("t").alias("a"), text.slug(F.col("t")).alias("s"), text.html_text(F.col("h")).alias("h"), text.encode_id("n").alias("e"), text.strip_tags("h").alias("st"),
        text.postcode(F.lit(" k1a 0a6 ")).alias("p"), text.session_id(F.lit("41st Parliament, 1st Session")).alias("x"), text.english_list(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("l"),
        text.strip_markdown_links(F.lit("see [a](u)")).alias("m"), text.highlight(F.lit("Ships sail"), "ship").alias("hl"), text.decode_id(text.encode_id("n")).alias("d"),
    ).first()
    assert (r.a, r.s, r.h, r.st, r.p, r.x) == ("Elan d’Etoile", "elan-d-etoile", "a\nb & c", "ab & c", "K1A0A6", "41-1")
    assert (r.l, r.m, r.hl, r.d) == ("a, b,  and c", "see a", "<em>Ships</em> sail", 70)


def test_keywords(spark):
    rows = [("s", "new ferry plan", 3, 0.9), ("s", "ferry plan", 2, 0.8), ("s", "plan b", 2, 0.7), ("s", "fish", 1, 0.5), ("s", "new", 1, 0.6)]
    df = spark.createDataFrame(rows, "source string, gram string, n int, score double")
    assert {r.gram for r in language.choose_keywords(df, ["source"]).collect()} == {"new ferry plan", "fish"}


def test_changes_order(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "k int, doc string").withColumn("v", F.lit(0))
    ch = spark.createDataFrame([(1, "delete", "", 1), (1, "update", "x", 2), (3, "update", "c", 3), (3, "update", "d", 4), (4, "update", "e", 5)], "k int, action string, doc string, v int")
    got = {r.k: r.doc for r in jobs.apply_changes(state, ch, "k", "v", existing=spark.createDataFrame([(1,), (3,)], "k int")).collect()}
    assert got == {2: "b", 3: "d"}


def test_entry_without_llm():
    """The entry file in a process in which the add-on package can't be imported."""
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('quorumlake.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert set(e.oracle_sql()) <= set(e.queries()) and 'p4_found' in e.queries() and 'p9_found' not in e.queries()\n"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def test_bridge_joins_every_riding(spark, tmp_path):
    held = [(1, 10, 3), (2, 10, 4), (3, 10, 4), (4, 20, 13), (4, 20, 13), (5, 30, 27), (6, None, 5)]
    spark.createDataFrame(held, "id int, politician_id int, riding_id int").write.parquet(f"{tmp_path}/elected_member.parquet")
    said = [(1, 1, 10), (2, 1, 20), (2, 1, 20), (3, 1, 30), (4, 1, 40), (5, 1, None)]
    spark.createDataFrame(said, "id int, imported_at int, politician_id int").write.parquet(f"{tmp_path}/statement.parquet")
    got = sorted((r.id, r.riding_id) for r in more.bridge(spark, str(tmp_path)).collect())
    assert got == [(1, 3), (1, 4), (2, 13), (3, 27)]


def test_fan_out_of_all_events(spark, tmp_path):
    events = [(1, 7, "view", 5.0), (2, 8, "view", 100.0), (3, 7, "error", 1.0), (1001, 9, "error", None), (1002, 9, "view", 2.0), (1003, 9, None, 2.0)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id: r.messages for r in more.fan_out(spark, str(tmp_path)).collect()} == {7: 5, 8: 3, 9: 5}
    sent = spark.createDataFrame([(1, "a"), (2, "b")], "event_id int, topic string")
    subs = spark.createDataFrame([("a", 1, True, False), ("a", 2, False, False), ("b", 3, True, True)], "topic string, user int, active boolean, bouncing boolean")
    assert [(r.event_id, r.user) for r in jobs.fan_out(sent, subs).collect()] == [(1, 1)]


def test_fan_out_counts_without_making_messages(spark, tmp_path):
    """A billion messages: 1 000 users with 1 000 events each of one type."""
    spark.range(1_000_000).selectExpr("id as event_id", "id % 1000 as user_id", "'view' as event_type").write.parquet(f"{tmp_path}/events.parquet")
    joined = []
    whole = jobs.fan_out
    try:
        jobs.fan_out = lambda sent, subs: joined.append(whole(sent, subs)) or joined[-1]
        got = more.fan_out(spark, str(tmp_path)).collect()
    finally:
        jobs.fan_out = whole
    assert joined[0].count() == 1000 and {r.messages for r in got} == {1_000_000} and len(got) == 1000


def test_absences_are_never_shuffled(spark, tmp_path):
    from datetime import date, timedelta

    from quorumlake.plans import records

    day = lambda k: date(2020, 1, 1) + timedelta(k)
    asked = [(k, day(k % 50)) for k in range(500)] + [(900, None), (3, day(3))]
    held = [(k, k, day(0), None) for k in range(100)]
    held += [(200, 100, day(3), day(5)), (201, 100, day(5), day(6)), (202, 100, day(8), day(8)), (203, 100, day(9), day(7)), (204, 101, None, None), (205, None, day(49), None), (206, 100, day(4), day(4))]
    ballots = [(k, k % 500, None, k % 103, "Y", False) for k in range(2000)] + [(5000, 3, None, None, "N", False), (5001, None, None, 4, "N", False)]
    for name, rows, cols in (
        ("vote_question", asked, "id long, date date"), ("elected_member", held, "id long, politician_id long, start_date date, end_date date"),
        ("member_vote", [(*b, None) for b in ballots], "id long, votequestion_id long, member_id long, politician_id long, vote string, dissent boolean, recorded_at timestamp_ntz"),
    ):
        spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/{name}.parquet")
    got = records.absent(spark, str(tmp_path))
    rows = [tuple(r) for r in got.collect()]
    cast = {(q, p, v) for _, q, _, p, v, _ in ballots}
    voted = {(q, p) for q, p, _ in cast if q is not None and p is not None}
    due = {(q, p) for q, t in asked if t for _, p, a, b in held if a and a <= t and (b is None or t <= b)}
    assert len(rows) == len(set(rows)) and set(rows) == cast | {(q, p, "A") for q, p in due - voted}
    nodes, sent = [got._jdf.queryExecution().executedPlan()], []
    while nodes:
        x = nodes.pop()
        if x.nodeName() == "AdaptiveSparkPlan":
            nodes.append(x.executedPlan())
        elif "QueryStage" in x.nodeName():
            rows_of = x.getRuntimeStatistics().rowCount() if "Shuffle" in x.nodeName() else None
            sent += [int(str(rows_of.get()))] if rows_of is not None and rows_of.isDefined() else []
            nodes.append(x.plan())
        else:
            nodes += [x.children().apply(i) for i in range(x.children().size())]
    assert sent and max(sent) < 10_000 < len(rows)
