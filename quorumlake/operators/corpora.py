"""The corpora that language models are made of, and stored models."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.operators import language

#: Least count of an n-gram in a stored model.
LEAST = {1: 5, 2: 5, 3: 3}


def corpora(st: DataFrame, as_of: Column, committees: DataFrame) -> DataFrame:
    """corpus and the columns of `st` (document_id, document_type, time …), a row for every corpus a statement is in: debates
    and all of the last 365 days ('debates', 'default'), debates of each earlier year since 1994 ('debates-Y'), and of each
    committee its documents of three years. `committees`: committee, document_id, date."""
    recent = F.col("time") >= as_of.cast("timestamp_ntz") - F.expr("interval 365 days")
    debate = F.col("document_type") == "D"
    year = F.year("time")
    names = F.array_compact(F.array(
        F.when(recent, F.lit("default")), F.when(recent & debate, F.lit("debates")),
        F.when(debate & (year >= 1994) & (year < F.year(as_of)), F.concat(F.lit("debates-"), year.cast("string"))),
    ))
    own = st.select(F.explode(names).alias("corpus"), *st.columns)
    late = committees.filter(F.col("date") >= F.date_sub(as_of, 365 * 3)).select(F.col("committee").alias("corpus"), "document_id").distinct()
    return own.unionByName(st.join(late, "document_id").select("corpus", *st.columns))


def models(members: DataFrame, text: str) -> DataFrame:
    """corpus, n, gram, cnt, p of the one-, two- and three-word models of every corpus."""
    got = None
    for n, least in LEAST.items():
        m = language.frequencies(members, ["corpus"], text, n, least).withColumn("n", F.lit(n))
        got = m if got is None else got.unionByName(m)
    return got


def safe_name(corpus: str) -> str:
    return re.sub(r"[^a-z0-9-]", "", corpus.lower())


def store(found: DataFrame, path: str) -> None:
    """Models as a table of their own folder per corpus and length, so that loading one reads nothing else."""
    rows = found.withColumn("corpus", F.regexp_replace(F.lower("corpus"), "[^a-z0-9-]", ""))
    rows.repartition("corpus", "n").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus", "n").parquet(path)


def load(spark: SparkSession, path: str, corpus: str, n: int) -> DataFrame:
    """gram, cnt, p of one stored model (S22); only its folder is read."""
    return spark.read.parquet(path).filter((F.col("corpus") == safe_name(corpus)) & (F.col("n") == n)).select("gram", "cnt", "p")


@dataclass(frozen=True)
class Analysis:
    """What a keyword analysis takes: which statements, which background, and how long its result holds (H4)."""

    name: str
    select: object  # DataFrame -> DataFrame
    corpus: object  # a value of the key -> name of the background corpus
    expires_days: int

    def is_stale(self, made: Column, as_of: Column) -> Column:
        return made.isNull() | (F.datediff(as_of, made) > self.expires_days)


ANALYSES = (
    Analysis("debate", lambda st: st.filter("document_type = 'D' and not procedural"), lambda year: f"debates-{year}", 10_000),
    Analysis("committee", lambda st: st.filter("document_type = 'E' and not procedural"), safe_name, 7),
    Analysis("person", lambda st: st.filter("not procedural"), lambda _: "default", 14),
)
