import json

from pyspark.sql import functions as F

from quorumlake.functions import markup as mk


def test_columns(spark):
    df = spark.createDataFrame([(1,)], "i int")
    note = json.dumps({"Message": json.dumps({"notificationType": "Bounce", "bounce": {"bounceType": "Permanent", "bouncedRecipients": [{"emailAddress": "a@b"}]}})})
    r = df.select(
        mk.stage_code(F.lit("Senate amendments at first reading")).alias("a"), mk.stage_code(F.lit("Troisième lecture")).alias("b"), mk.stage_code(F.lit("x")).alias("c"),
        mk.bill_stage(F.lit("Bill C-27. Second reading"), F.lit(None)).alias("s1"), mk.bill_stage(F.lit("Report stage"), F.lit("C-27,2")).alias("s2"),
        mk.bill_stage(F.lit("Amendment negatived"), F.lit("C-27,2")).alias("s3"), mk.bill_stage(F.lit("Projet de loi S-4 - Étude"), F.lit("C-27,2")).alias("s4"),
        mk.marked_text(F.lit('<p data-HoCid="7" x="1">Hi</p>'), F.lit("/u/")).alias("d"),
        mk.valid_links(F.lit("[a](x) [b](y)"), F.array(F.lit("x"))).alias("e"), mk.plain_alert(F.lit("<em>a</em> &#39;b")).alias("f"),
        mk.tame_legacy(F.lit("He said: CANADA'S best")).alias("g"), mk.fenced_json(F.lit('```json\n{"k": 3}\n```'), "k int")["k"].alias("h"),
        mk.token_sum(F.lit('[{"total_tokens": 2}, {"total_tokens": 3}, {}]')).alias("i1"), mk.token_sum(F.lit('{"total_tokens": 4}')).alias("i2"), mk.token_sum(F.lit("{}")).alias("i3"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("1", "3", "other[x]", "[/u/#7] Hi", ["y"], "**a** 'b")
    assert (r.s1, r.s2, r.s3, r.s4) == ("C-27,2", "C-27,report", "C-27,2", "S-4,other[Étude]")
    assert (r.g, r.h, r.i1, r.i2, r.i3) == ("CANADA's best", 3, 5, 4, 0)
    hooks = spark.createDataFrame([(note,), ("{}",), (None,)], "body string")
    assert [tuple(x) for x in mk.bounces(hooks, "body").collect()] == [("a@b", "bounce")]


def test_tables(spark):
    df = spark.createDataFrame([(1, "see [a](http://x/1) and [b](http://x/2)"), (2, "none"), (3, None)], "id int, t string")
    got, table = mk.opaque_urls(df, "id", "t")
    rows = {r.id: r.t for r in got.collect()}
    assert table.count() == 2 and "http" not in rows[1] and rows[2] == "none" and rows[3] is None
    c = spark.createDataFrame([(1, '<a data-HoCid="5">A</a> <a data-HoCid="6">B</a>'), (2, None)], "id int, c string")
    out = {r.id: r.c for r in mk.linked(c, "id", "c", spark.createDataFrame([(5, "/p/5")], "hocid long, url string")).collect()}
    assert out[1] == '<a data-HoCid="5" href="/p/5">A</a> <a data-HoCid="6">B</a>' and out[2] is None
    m = spark.createDataFrame([(1, "b", True, 1), (1, "a", True, 2), (1, "z", False, 0), (2, "q", False, 1)], "m int, n string, s boolean, o int")
    assert {r.m: r.summary for r in mk.meeting_summary(m, "m", "n", "s", "o").collect()} == {1: "b and a", 2: "q"}
    u = mk.unique_slugs(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "i int, b string"), "b", F.col("i"))
    assert sorted(r.slug for r in u.collect()) == ["x", "x-2", "y"]


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi",
            "relational": "relat", "digitizer": "digit", "electrical": "electr", "adoption": "adopt", "controlling": "control", "rate": "rate", "is": "is"}
    assert {w: mk.stem(w) for w in want} == want
