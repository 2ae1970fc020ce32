"""The queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.catalog import table
from quorumlake.llm.alignment import aligned
from quorumlake.llm.mixing import EXACT, mix
from quorumlake.llm.packing import fill_containers, unused
from quorumlake.llm.sizes import token_sizes
from quorumlake.llm.quality import text_quality
from quorumlake.llm.truncation import find_truncated
from quorumlake.llm.turns import speaker_turns
from quorumlake.llm.variants import link_variants, variant_pairs
from quorumlake.session import written


def _truncated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return find_truncated(table(spark, folder, "statement"), key="id", source="feed", fields=["who_en", "who_context_en"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _truncated(spark, folder)[0].select(F.col("id").alias("statement_id"), "field_name")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut values per feed and field."""
    return _truncated(spark, folder)[1]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "statement").select(
        F.lit("statement").alias("record_kind"), F.col("id").alias("record_id"), F.col("imported_at").alias("version"),
        F.col("content_en").alias("en"), F.col("content_fr").alias("fr"),
    )
    bills = table(spark, folder, "bill_text").select(
        F.lit("bill_text").alias("record_kind"), F.col("id").alias("record_id"), F.col("created").alias("version"),
        F.col("text_en").alias("en"), F.col("text_fr").alias("fr"),
    )
    return aligned(said.unionByName(bills))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    captions = table(spark, folder, "statement").filter("feed = 'live_captions'")
    return speaker_turns(
        captions.select("id", "document_id", "time", F.col("who_en").alias("who"), F.col("content_en").alias("content"))
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder).select("document_id", "turn_no", F.col("id").alias("statement_id")).distinct()


def p3_turns(spark: SparkSession, folder: str) -> DataFrame:
    """One row per turn: speaker, time of the first fragment, all words in order. A turn is the words of one speaker until
    the next, gathered only for the output."""
    parts = _turns(spark, folder).withColumnRenamed("id", "statement_id")
    return parts.groupBy("document_id", "turn_no", "speaker").agg(
        F.min("time").alias("started"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("time", "statement_id", "part_no", "words"))), lambda x: x["words"]), " "
        ).alias("words"),
    )


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = written(token_sizes(table(spark, folder, "documents"), "doc_id", "text"), "p7-sizes")
    return fill_containers(sizes, table(spark, folder, "container_spec"))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every text with its container, for each capacity."""
    return _packed(spark, folder)


def p7_unused(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and unused share per capacity."""
    return unused(_packed(spark, folder))


def _mixed(spark: SparkSession, folder: str, total: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    sizes = token_sizes(table(spark, folder, "documents").filter("source is not null"), "doc_id", "text", "source")
    return mix(sizes, table(spark, folder, "source_weight"), total=total)


def p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The selection of as many tokens as the sources hold: text, source, number of uses."""
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares per source of p8_mixed."""
    return _mixed(spark, folder)[1]


def p8_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The largest selection in which every source that has texts holds its share."""
    return _mixed(spark, folder, EXACT)[0]


def p8_exact_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares per source of p8_exact."""
    return _mixed(spark, folder, EXACT)[1]


def _variants(spark: SparkSession, folder: str) -> DataFrame:
    witnesses = table(spark, folder, "statement").filter("statement_type = 'witness'")
    return link_variants(witnesses, key="id", name="who_en", context="who_context_en")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return variant_pairs(_variants(spark, folder))


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed form with its entity and number of links."""
    return _variants(spark, folder)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return text_quality(table(spark, folder, "documents")).filter("form <> 'prose'").select("doc_id", "form")


def p9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """All statistics, the outlier score and the form of every document."""
    return text_quality(table(spark, folder, "documents"))


# --- what can be said in SQL of the results ----------------------------------------------------------------------------------


def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values per feed and field that the report counts: none is lost, a row sent again counts once."""
    return p1_report(spark, folder).select("feed", "field_name", "n_values")


def p5_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed form comes out once, under its smallest id, in an entity whose smallest form is its name."""
    forms = _variants(spark, folder)
    least = forms.groupBy("entity").agg(F.min("fid").alias("least"))
    return forms.join(least, "entity").select("fid", "who_en", "who_context_en", (F.col("least") == F.col("entity")).alias("named"))


def p7_conserved(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity: texts packed, containers over their capacity, texts that fit whole and were split, gaps or overlaps of pieces."""
    p = _packed(spark, folder)
    texts = p.groupBy("spec_id", "capacity", "doc_id").agg(
        F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.max(F.col("first_token") + F.col("n_tokens")).alias("e"), F.countDistinct("first_token").alias("f")
    ).groupBy("spec_id", "capacity").agg(
        F.count("*").alias("texts"), F.count_if((F.col("t") <= F.col("capacity")) & (F.col("k") > 1)).alias("split"), F.count_if((F.col("t") != F.col("e")) | (F.col("k") != F.col("f"))).alias("broken")
    )
    over = p.groupBy("spec_id", "capacity", "container").agg(F.sum("n_tokens").alias("t")).groupBy("spec_id", "capacity").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    return texts.join(over, ["spec_id", "capacity"])


def p8_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Per source with a target: texts used more often than allowed, texts of another source, and whether shares add up."""
    selection, report = _mixed(spark, folder)
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("own"))
    used = selection.join(docs, "doc_id").join(F.broadcast(report.select("source", "max_repeats")), "source")  # one row per source
    bad = used.groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over"), F.count_if(F.col("source") != F.col("own")).alias("foreign"))
    total = report.agg((F.round(F.sum("reached_share"), 6) == 1).alias("whole"))
    got = report.select("source", "target_share").join(bad, "source", "left").na.fill(0, ["over", "foreign"])
    return got.crossJoin(F.broadcast(total))  # one row


def p9_covered(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is judged once, and equal texts of one language alike."""
    q = written(p9_quality(spark, folder).select("doc_id", "form", "lang_group"), "p9-judged")
    docs = table(spark, folder, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    alike = q.join(docs, "doc_id").groupBy("m", "lang_group").agg(F.countDistinct("form").alias("forms")).agg(F.count_if(F.col("forms") > 1).alias("unlike"))
    return q.agg(F.count("*").alias("documents"), F.countDistinct("doc_id").alias("distinct_ids")).crossJoin(F.broadcast(alike))  # one row


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found, "p3_found": p3_found, "p3_turns": p3_turns, "p5_found": p5_found, "p5_forms": p5_forms, "p7_packed": p7_packed, "p7_unused": p7_unused, "p8_mixed": p8_mixed, "p8_shares": p8_shares, "p8_exact": p8_exact, "p8_exact_shares": p8_exact_shares, "p9_found": p9_found, "p9_quality": p9_quality, "p1_values": p1_values, "p5_typed": p5_typed, "p7_conserved": p7_conserved, "p8_limits": p8_limits, "p9_covered": p9_covered}
ORACLE: dict[str, str] = {
    "p1_values": """WITH r AS (SELECT DISTINCT id, COALESCE(feed, '') AS feed, who_en, who_context_en FROM statement), v AS (SELECT feed, 'who_en' AS field_name, id, who_en AS x FROM r UNION ALL SELECT feed, 'who_context_en', id, who_context_en FROM r)
        SELECT feed, field_name, CAST(count(*) AS BIGINT) AS n_values FROM v WHERE x <> '' GROUP BY feed, field_name""",
    "p5_typed": "SELECT min(id) AS fid, who_en, who_context_en, true AS named FROM statement WHERE statement_type = 'witness' GROUP BY who_en, who_context_en",
    "p7_conserved": "SELECT CAST(spec_id AS INTEGER) AS spec_id, CAST(capacity_tokens AS INTEGER) AS capacity, (SELECT count(*) FROM documents WHERE text <> '') AS texts, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS overfull FROM (SELECT DISTINCT * FROM container_spec) c",
    "p8_limits": "SELECT source, max(target_share) AS target_share, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS \"foreign\", true AS whole FROM source_weight GROUP BY source",
    "p9_covered": "SELECT count(*) AS documents, count(DISTINCT doc_id) AS distinct_ids, CAST(0 AS BIGINT) AS unlike FROM documents",
}
