"""Full-text search over a document table: query grammar, postings, ranking, facets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.dates import month_range
from quorumlake.functions.text import plain_letters

_FILTER = re.compile(r'(\w+): ?"([^"]+)"')


@dataclass(frozen=True)
class Asked:
    """A parsed query: filters by name and the rest of the words."""

    filters: dict[str, str]
    text: str

    def canonical(self) -> str:
        return " ".join([self.text] * bool(self.text) + [f'{k}: "{v}"' for k, v in sorted(self.filters.items())])


def parse(raw: str, known: set[str]) -> Asked:
    """`Name: "value"` for known names (the last of a name counts) and bare text with single blanks."""
    filters = {k: v for k, v in _FILTER.findall(raw) if k in known}
    rest = _FILTER.sub(lambda m: "" if m[1] in known else m[0], raw)
    return Asked(filters, " ".join(rest.split()))


# Words that aren't searched for.
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def stemmed(index: DataFrame) -> DataFrame:
    """`index` (term, key, tf) by stems, without stop words (F32): the distinct terms are stemmed, never the texts."""
    from quorumlake.functions.markup import stems

    words = index.select("term").distinct().filter(~F.col("term").isin(STOP)).withColumn("stem", stems("term"))
    keys = [c for c in index.columns if c not in ("term", "tf")]
    return index.join(words, "term").groupBy(F.col("stem").alias("term"), *keys).agg(F.sum("tf").alias("tf"))


#: Orders a request may ask for; any other is by score (Q6).
SORTS = {"score desc": ("score", False), "date asc": ("date", True), "date desc": ("date", False)}


def ordered(hits: DataFrame, sort: str, key: str) -> list:
    """The columns to order hits (score, date) by."""
    column, up = SORTS.get(sort, SORTS["score desc"])
    return [F.asc_nulls_last(column) if up else F.desc_nulls_last(column), F.asc(key)]


def found(docs: DataFrame, index: DataFrame, asked: Asked, columns: dict[str, str], key: str) -> DataFrame:
    """key, score of a parsed query: the filters on `columns` (name -> column), then the words; filters without any word match
    all that fits, with score 1 (Q3)."""
    for name, value in asked.filters.items():
        docs = docs.filter(F.col(columns[name]) == value)
    words = re.findall(r"\w+", asked.text.lower())
    if not words:
        return docs.select(key, F.lit(1.0).alias("score"))
    return ranked(index.join(docs.select(key), key, "left_semi"), docs.agg(F.count("*").alias("n")), words, key)


def redirect(raw: DataFrame, people: DataFrame, ridings: DataFrame, held: DataFrame) -> DataFrame:
    """query, url of queries that lead straight to a page (Q10): a postal code with a riding to who holds it, the exact name of
    one person to that person. `raw`: query; `people`: id, name, slug; `ridings`: code, riding_id; `held`: riding_id,
    politician_id of those in office."""
    from quorumlake.functions import text as tx

    url = tx.person_url(F.col("slug"), F.col("id"))
    code = raw.withColumn("code", tx.postcode(F.col("query"))).join(ridings, "code").join(held, "riding_id").join(people.withColumnRenamed("id", "politician_id"), "politician_id")
    by_code = code.groupBy("query").agg(F.min_by(tx.person_url(F.col("slug"), F.col("politician_id")), "politician_id").alias("url"))
    named = raw.withColumn("_n", plain_letters(F.lower(F.trim("query")))).join(people.withColumn("_n", plain_letters(F.lower("name"))), "_n")
    by_name = named.groupBy("query").agg(F.count("*").alias("n"), F.min(url).alias("url")).filter("n = 1").select("query", "url")
    return by_code.unionByName(by_name.join(by_code.select("query"), "query", "left_anti"))


@dataclass(frozen=True)
class Source:
    """What search indexes of one kind of record (H1): the rows, which of them, and what a row looks like."""

    kind: str
    rows: object  # () -> DataFrame
    document: dict  # name -> Column
    should_index: object = None  # a condition, or None for all


def search_documents(sources: list[Source]) -> DataFrame:
    """id, kind, json of the rows of all sources that should be indexed; fields that are null are left out."""
    got = None
    for src in sources:
        if not {"id"} <= set(src.document):
            raise ValueError(f"{src.kind} has no id")
        rows = src.rows()
        rows = rows.filter(src.should_index) if src.should_index is not None else rows
        fields = [c.alias(n) for n, c in src.document.items() if n != "id"]
        one = rows.select(src.document["id"].cast("string").alias("id"), F.lit(src.kind).alias("kind"), F.to_json(F.struct(*fields)).alias("json"))
        got = one if got is None else got.unionByName(one)
    return got


def terms(text, least: int = 1):
    """Search terms of a text column: lower case, no accents, possessives off, cut at all but letters and digits."""
    c = F.regexp_replace(plain_letters(F.lower(text)), "['’]s\\b", "")
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= least)


def postings(docs: DataFrame, key: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """term, key, tf: the inverted index; one row per different term of a document."""
    got = docs.select(key, F.explode(terms(F.col(text))).alias("term"))
    if stop:
        got = got.filter(~F.col("term").isin(stop))
    return got.groupBy("term", key).agg(F.count("*").alias("tf"))


def ranked(index: DataFrame, docs_n: int | DataFrame, words: list[str], key: str, k1: float = 1.2, all_terms: bool = False) -> DataFrame:
    """key, score: BM25 without length norm; with `all_terms` only documents that hold every word. Only the postings of the
    words asked are read; they are aggregated by document. `docs_n` is the number of documents, or a frame of one row with it
    as n, so nothing is counted while the plan is made."""
    words = sorted(set(words))
    hit = index.filter(F.col("term").isin(words))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))  # one row per word asked
    df = df.crossJoin(F.broadcast(docs_n)) if isinstance(docs_n, DataFrame) else df.withColumn("n", F.lit(docs_n))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = hit.join(F.broadcast(df), "term").withColumn("_s", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1))
    got = part.groupBy(key).agg(F.sum("_s").alias("score"), F.count("*").alias("_hits"))
    return (got.filter(F.col("_hits") == len(words)) if all_terms else got).drop("_hits")


def facets(df: DataFrame, fields: list[str], most: int | None = None) -> DataFrame:
    """field, value, n (at least 1) for all fields in one pass: rows are expanded after column pruning and counted before the
    shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return df.select(pairs.alias("p")).select("p.field", "p.value").filter("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))


def within_dates(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose date lies in the range the filter text names."""
    r = month_range(F.lit(text))
    return df.filter((F.col(column).cast("timestamp_ntz") >= r["lo"]) & (F.col(column).cast("timestamp_ntz") <= r["hi"]))
