"""Debates as ordered statements: sections, long speeches, headings, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions.text import slug
from quorumlake.operators.runs import ordinals, run_numbers


#: Statements of a document that one task scans; sittings of any length are scanned in such chunks.
CHUNK = 1000


def _chunked(st: DataFrame) -> DataFrame:
    return st.withColumn("_chunk", F.floor(F.col("sequence") / CHUNK))


def long_speeches(st: DataFrame, least: int = 500, gap: int = 3, flush: bool = False) -> DataFrame:
    """document_id, member, first_seq, last_seq, words of the runs of one speaker whose statements are at most `gap` apart
    in sequence and hold more than `least` words (A20). The last run of a document is left out unless `flush`, as nothing
    closes it; unknown speakers are one speaker."""
    near = lambda p, c: p["member"].eqNullSafe(c["member"]) & (c["sequence"] - p["sequence"] >= 1) & (c["sequence"] - p["sequence"] <= gap)
    runs = run_numbers(_chunked(st), ["document_id"], ["sequence"], ["member", "sequence"], "_run", "_chunk", near)
    got = runs.groupBy("document_id", "_run").agg(
        F.first("member").alias("member"), F.min("sequence").alias("first_seq"), F.max("sequence").alias("last_seq"), F.sum("wordcount").alias("words")
    )
    if not flush:
        last = runs.groupBy("document_id").agg(F.max("_run").alias("_last"))
        got = got.join(last, "document_id").filter("_run < _last").drop("_last")
    return got.filter(F.col("words") > least).drop("_run")


def headings(st: DataFrame, heading: str) -> DataFrame:
    """document_id, position, heading: the headings in order without repeats of the one before; statements without one are
    passed over (A23)."""
    rows = st.filter((F.col(heading).isNotNull()) & (F.col(heading) != "")).select("document_id", "sequence", F.col(heading).alias("heading"))
    runs = run_numbers(_chunked(rows), ["document_id"], ["sequence"], "heading", "position", "_chunk")
    return runs.groupBy("document_id", "position").agg(F.first("heading").alias("heading"))


def heading_runs(st: DataFrame, keys: list[str], least: int) -> DataFrame:
    """document_id, run, keys, statements, words of consecutive statements with equal keys and at least `least` words that
    aren't procedural (A26)."""
    boxed = st.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    runs = run_numbers(_chunked(boxed), ["document_id"], ["sequence"], "_key", "run", "_chunk")
    spoken = F.sum(F.when(F.col("procedural"), 0).otherwise(F.col("wordcount")))
    got = runs.groupBy("document_id", "run").agg(*[F.first(k).alias(k) for k in keys], F.count("*").alias("statements"), spoken.alias("words"))
    return got.filter(F.col("words") >= least)


def statement_slugs(st: DataFrame, who: Column, most: int = 50) -> DataFrame:
    """`slug_no`: name-N in the order of the document, N from 1 for each name (W4); a name without letters is 'procedural'."""
    base = F.trim(F.substring(F.trim(F.translate(slug(who), "-", " ")), 1, most))
    base = F.regexp_replace(base, " +", "-")
    named = st.withColumn("_base", F.when(base == "", "procedural").otherwise(base))
    got = ordinals(_chunked(named), ["document_id", "_base"], ["sequence", "id"], "_no", "_chunk")
    return got.withColumn("slug_no", F.concat_ws("-", "_base", F.col("_no").cast("string"))).drop("_base", "_no", "_chunk")


def timed_slugs(st: DataFrame, who: Column, most: int = 50) -> DataFrame:
    """`slug_time`: name-HHMM, and -2, -3 … from the second in the same minute."""
    base = F.regexp_replace(F.trim(F.substring(F.trim(F.translate(slug(who), "-", " ")), 1, most)), " +", "-")
    named = st.withColumn("_base", F.concat_ws("-", F.when(base == "", "procedural").otherwise(base), F.date_format("time", "HHmm")))
    got = ordinals(_chunked(named), ["document_id", "_base"], ["sequence", "id"], "_no", "_chunk")
    return got.withColumn("slug_time", F.when(F.col("_no") > 1, F.concat_ws("-", "_base", F.col("_no").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_no", "_chunk")


def speakers(st: DataFrame) -> DataFrame:
    """document_id, who, person, first_seq, slug, politician, minister, description of those who spoke (A22). `st`:
    document_id, sequence, id, who, who_hocid, name (of a known member, else null), context, slug. Of each number the first
    statement counts, of several numbers under one name to show the first; a label is shown without brackets and its first
    word. Both choices are aggregates, so no document is sorted."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("who", r"\s*\(.+\)\s*", ""), r"^\s*\S+\s+", ""))
    at = F.struct("sequence", "id", "who", "name", "context", "slug")
    firsts = st.filter("who_hocid is not null").groupBy("document_id", "who_hocid").agg(F.min(at).alias("x"))
    firsts = firsts.select("document_id", "who_hocid", "x.*").withColumn("shown", F.coalesce("name", bare))
    got = firsts.groupBy("document_id", "shown").agg(F.min(F.struct("sequence", "id", "who_hocid", "name", "context", "slug")).alias("x"))
    known = F.col("x.name").isNotNull()
    office = F.coalesce(F.col("x.context").rlike("Minist(?:er|re) "), F.lit(False))
    return got.select(
        "document_id", F.col("shown").alias("who"), F.col("x.who_hocid").alias("person"), F.col("x.sequence").alias("first_seq"), F.col("x.slug").alias("slug"), known.alias("politician"),
        (known & office).alias("minister"), F.nullif(F.col("x.context"), F.lit("")).alias("description"),
    )


def outside_speakers(found: DataFrame) -> DataFrame:
    """Ministers, and who is neither a member nor a clerk."""
    return found.filter(F.col("minister") | ~(F.col("politician") | F.col("who").startswith("Clerk ")))


def member_speakers(found: DataFrame) -> DataFrame:
    """Members who aren't ministers."""
    return found.filter("politician and not minister")


def run_minutes(st: DataFrame, heading: str) -> DataFrame:
    """document_id, run, heading, minutes of consecutive statements under one heading, whole minutes from the first to the
    last; days don't count (W10)."""
    runs = run_numbers(_chunked(st.withColumn("_h", F.col(heading))), ["document_id"], ["sequence"], "_h", "run", "_chunk")
    at = F.struct("sequence", "time")
    got = runs.groupBy("document_id", "run").agg(F.first("_h").alias("heading"), F.min(at)["time"].alias("a"), F.max(at)["time"].alias("z"))
    secs = F.pmod(F.unix_timestamp(F.col("z").cast("timestamp")) - F.unix_timestamp(F.col("a").cast("timestamp")), F.lit(86400))
    return got.select("document_id", "run", "heading", F.floor(secs / 60).alias("minutes"))


def activity(st: DataFrame, least: int = 0) -> DataFrame:
    """document_id, politician_id, topic, words, longest (id): one row per person and topic, with the longest statement."""
    said = st.filter("politician_id is not null and not procedural")
    got = said.groupBy("document_id", "politician_id", "topic").agg(
        F.sum("wordcount").alias("words"), F.max(F.struct("wordcount", (-F.col("id")).alias("n")))["n"].alias("_n")
    )
    return got.filter(F.col("words") >= least).select("document_id", "politician_id", "topic", "words", (-F.col("_n")).alias("longest"))


# --- sections ------------------------------------------------------------------------------------------------------------

# Business that is one section whatever the headings below it, and how it is shown.
SHOWN = {"oral questions": "Question Period", "oral question period": "Question Period", "adjournment proceedings": "Adjournment Debates",
         "statements by members": "Statements by Members"}
PETITIONS = "Petitions"


def sections(st: DataFrame, per_chunk: int = 1000) -> DataFrame:
    """Sections of every document of `st` (document_id, sequence, time, slug, h1, h2, h3, bill, stage, wordcount, procedural),
    one row each (A19), in order of appearance by first_seq.

    Statements under an h2 that begins 'questions ' are passed over, except as the first. Of the others consecutive ones
    belong together if they have one h1 of `SHOWN`; or one h1 and one h2 that lies within the word of `PETITIONS`, an empty h2
    too; or one (h1, h2, h3, bill). Each rule asks both statements the same, so a run is a run of one key, and runs are
    numbered in two levels. Runs without words that aren't procedural are dropped; those of one (bill, stage), or without a
    bill of one heading (lower case), are put together, with a new segment where more than five in sequence and some time lie
    between. Sections of stage 1, of 500 words or with a statement of 300 are kept. Null headings count as empty, null counts
    as 0; statements without document or sequence are left out. Minutes wrap at a day."""
    heads = ["h1", "h2", "h3"]
    said = st.filter("document_id is not null and sequence is not null").select(
        "document_id", "sequence", "time", "slug", *[F.coalesce(h, F.lit("")).alias(h) for h in heads], "bill", "stage",
        F.coalesce("wordcount", F.lit(0)).alias("wordcount"), F.coalesce("procedural", F.lit(False)).alias("procedural"),
    )
    first = said.groupBy("document_id").agg(F.min("sequence").alias("_first"))
    kept = said.join(first, "document_id").filter((F.col("sequence") == F.col("_first")) | ~F.lower("h2").startswith("questions "))
    special = F.lower("h1").isin(list(SHOWN))
    key = F.when(special, F.array("h1")).when(F.lit(PETITIONS).contains(F.col("h2")), F.array("h1", "h2")).otherwise(
        F.array("h1", "h2", "h3", F.coalesce("bill", F.lit("")))
    )
    kept = kept.withColumn("_key", F.to_json(key)).withColumn("_chunk", F.floor(F.col("sequence") / per_chunk))
    runs = run_numbers(kept, ["document_id"], ["sequence"], "_key", "_run", "_chunk")
    head, tail = F.struct("sequence", "time", "slug", *heads, "bill", "stage"), F.struct("sequence", "time")
    spoken = F.sum(F.when(F.col("procedural"), 0).otherwise(F.col("wordcount")))
    one = [F.when((F.min(F.lower(h)) == F.max(F.lower(h))) & (F.min(h) != ""), F.min_by(h, "sequence")).alias(f"_one_{h}") for h in heads]
    run = runs.groupBy("document_id", "_run").agg(
        F.min(head).alias("a"), F.max(tail).alias("z"), spoken.alias("words"), F.count("*").alias("statements"), F.max("wordcount").alias("longest"), *one
    )
    run = run.filter("words <> 0")
    secs = F.pmod(F.unix_timestamp(F.col("z.time").cast("timestamp")) - F.unix_timestamp(F.col("a.time").cast("timestamp")), F.lit(86400))
    run = run.withColumn("minutes", F.coalesce(F.floor(secs / 60), F.lit(0)))
    billed = F.coalesce(F.col("a.bill"), F.lit("")) != ""
    same = F.when(billed, F.array("a.bill", F.coalesce("a.stage", F.lit("")))).otherwise(F.array(*[F.lower(f"a.{h}") for h in heads]))
    run = run.withColumn("_same", F.to_json(F.struct(billed.alias("b"), same.alias("k"))))
    # One row per run: a sitting has some hundreds.
    along = Window.partitionBy("document_id", "_same").orderBy("_run")
    before = F.lag("z").over(along)
    apart = (F.col("a.sequence") - before["sequence"] > 5) & ~F.col("a.time").eqNullSafe(before["time"])
    run = run.withColumn("_apart", F.coalesce(apart, F.lit(False)).cast("int"))
    got = run.groupBy("document_id", "_same").agg(
        F.min(F.struct("_run", "a", *[f"_one_{h}" for h in heads]))["a"].alias("a"), F.sum("words").alias("words"), F.sum("minutes").cast("int").alias("minutes"),
        F.sum("statements").alias("statements"), F.max("longest").alias("longest"), (1 + F.sum("_apart")).cast("int").alias("segments"),
        *[F.when((F.min(F.lower(f"_one_{h}")) == F.max(F.lower(f"_one_{h}"))) & (F.count(f"_one_{h}") == F.count("*")), F.min_by(f"_one_{h}", "_run")).alias(f"_one_{h}") for h in heads],
    )
    shown = F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv])
    heading = F.coalesce(
        F.try_element_at(shown, F.lower("a.h1")), F.when(F.coalesce(F.col("a.bill"), F.lit("")) != "", F.col("a.h2")), "_one_h3", "_one_h2", "_one_h1"
    )
    return got.filter((F.col("a.stage") == "1") | (F.col("words") >= 500) | (F.col("longest") >= 300)).select(
        "document_id", F.col("a.sequence").alias("first_seq"), F.col("a.slug").alias("slug"), *[F.col(f"a.{h}").alias(h) for h in heads],
        F.col("a.bill").alias("bill"), F.col("a.stage").alias("stage"), heading.alias("display_heading"), "words", "minutes", "statements", "longest", "segments",
    )


def subheads(st: DataFrame, found: DataFrame) -> DataFrame:
    """document_id, first_seq (of the section), heading, slug of the first statement under each heading of the sections
    `found` (as of `sections`) that list them (R3): h2 under the business of `SHOWN`, h3 under petitions."""
    inside = st.select("document_id", "sequence", "slug", "h1", "h2", "h3", "bill")
    f = found.filter(F.lower("h1").isin(list(SHOWN)) | (F.col("h2") == PETITIONS)).select("document_id", "first_seq", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    got = inside.join(f, (inside["document_id"] == f["document_id"]) & (F.lower("h1") == F.lower("_h1")) & (F.lower("_h1").isin(list(SHOWN)) | (F.lower("h2") == F.lower("_h2")))).drop(f["document_id"])
    heading = F.when(F.lower("h1").isin(list(SHOWN)), F.col("h2")).otherwise(F.col("h3"))
    return got.withColumn("heading", heading).filter("heading <> ''").groupBy("document_id", "first_seq", "heading").agg(F.min_by("slug", "sequence").alias("slug"))


# --- lists of topics, texts, stored sections ------------------------------------------------------------------------------


def topics(st: DataFrame, heading: str, question_period: bool = False) -> DataFrame:
    """document_id, position, heading, slug: the headings in order without repeats of the one before, each with the slug of its
    first statement; statements without a heading are passed over (A23). With `question_period` the first statement under
    'Oral Questions' comes before them, at position 0."""
    rows = st.filter((F.col(heading).isNotNull()) & (F.col(heading) != "")).select("document_id", "sequence", "slug", F.col(heading).alias("heading"))
    runs = run_numbers(_chunked(rows), ["document_id"], ["sequence"], "heading", "position", "_chunk")
    got = runs.groupBy("document_id", "position").agg(F.min(F.struct("sequence", "heading", "slug")).alias("x")).select("document_id", "position", "x.heading", "x.slug")
    if not question_period:
        return got
    first = st.filter("h1 = 'Oral Questions'").groupBy("document_id").agg(F.min(F.struct("sequence", "slug"))["slug"].alias("slug"))
    return got.unionByName(first.select("document_id", F.lit(0).cast("long").alias("position"), F.lit("Question Period").alias("heading"), "slug"))


def transcript_texts(st: DataFrame, by: str) -> DataFrame:
    """`by`, text: the statements of each group in order as blocks of lines (K14): name, address, party and riding of a member,
    title, and the text. `st`: by, sequence, name, url, party, riding, title, body; null lines are left out. A text is one
    value by its definition."""
    line = lambda head, c: F.coalesce(F.concat(F.lit(f"{head}: "), F.col(c), F.lit("\n")), F.lit(""))
    block = F.concat(line("Name", "name"), line("URL", "url"), line("Party", "party"), line("Riding", "riding"), line("Title", "title"), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("sequence", block.alias("b"))))
    return st.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n----\n\n").alias("text"))


def stored_or(found: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, sections (JSON), source of every document: a public summary with content where there is one, else the sections of
    `found` in order (J26). `stored`: key, json, public."""
    ready = stored.filter("public and json <> ''").groupBy(key).agg(F.max("json").alias("json"))
    made = found.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns))), {"ignoreNullFields": "false"}).alias("_made"))
    got = made.join(ready, key, "full")
    return got.select(key, F.coalesce("json", "_made").alias("sections"), F.when(F.col("json").isNotNull(), "stored").otherwise("computed").alias("source"))
