"""Markup, links, stems and JSON of other systems."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a bill's stage is named, in the order in which the names are tried.
STAGES = (
    ("first reading", "1"), ("première lecture", "1"), ("senate", "senate"), ("du sénat", "senate"), ("second reading", "2"), ("deuxième lecture", "2"),
    ("third reading", "3"), ("troisième lecture", "3"), ("report stage", "report"), ("étape du rapport", "report"),
)
_BILL = r"(?is)^\s*(?:Projet de loi|Bill)\s+([CS]).(\d+)[,:\-.\s]+(.+)"


def stage_code(text: Column) -> Column:
    """Code of the first stage of STAGES that the text names, 'other[text]' for none."""
    out = None
    for name, code in STAGES:
        hit = F.lower(text).contains(name)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(F.concat(F.lit("other["), text, F.lit("]")))


def bill_stage(text: Column, current: Column) -> Column:
    """'number,stage' after a heading (F24): of the bill it names, or of the bill of `current` where it names only a known
    stage; else `current` stays."""
    number = F.concat_ws("-", F.regexp_extract(text, _BILL, 1), F.regexp_extract(text, _BILL, 2))
    own = F.concat_ws(",", number, stage_code(F.regexp_extract(text, _BILL, 3)))
    known = ~stage_code(text).startswith("other[")
    return F.when(text.rlike(_BILL), own).when(current.isNotNull() & known, F.concat_ws(",", F.split_part(current, F.lit(","), F.lit(1)), stage_code(text))).otherwise(current)


def marked_text(content: Column, url: Column) -> Column:
    """Plain text whose paragraphs begin with [url#pid]."""
    x = F.regexp_replace(content, r'<p[^>]*data-HoCid="(\d+)"[^>]*>', "[URLMARK#$1] ")
    return F.trim(F.regexp_replace(F.replace(x, F.lit("URLMARK"), url), "<[^>]*>", ""))


def valid_links(text: Column, known: Column) -> Column:
    """Targets of markdown links that aren't among `known`."""
    found = F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), 1)
    return F.array_except(found, known)


def plain_alert(text: Column) -> Column:
    """Highlights as stars, escaped characters as themselves."""
    x = F.replace(F.replace(text, F.lit("<em>"), F.lit("**")), F.lit("</em>"), F.lit("**"))
    return _unescape(x)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def tame_legacy(text: Column) -> Column:
    """'He said:' in front dropped, 'S after capitals as 's."""
    return F.regexp_replace(F.regexp_replace(text, r"^(?:He|She|They) said:\s*", ""), r"\b([A-Z]+)'S\b", "$1's")


def fenced_json(reply: Column, schema: str) -> Column:
    """The JSON of a reply that may stand in a code fence; null where it is none."""
    return F.from_json(F.regexp_replace(F.trim(reply), r"(?s)^```(?:json)?\s*|\s*```$", ""), schema)


def bounces(hooks: DataFrame, body: str) -> DataFrame:
    """address, kind of the recipients in notification bodies, whose Message is JSON inside a JSON string."""
    inner = F.from_json(F.from_json(body, "Message string")["Message"], "notificationType string, bounce struct<bounceType: string, bouncedRecipients: array<struct<emailAddress: string>>>, complaint struct<complainedRecipients: array<struct<emailAddress: string>>>")
    m = hooks.select(inner.alias("m"))
    gone = m.filter("m.notificationType = 'Bounce' and m.bounce.bounceType = 'Permanent'").select(F.explode("m.bounce.bouncedRecipients.emailAddress").alias("address"), F.lit("bounce").alias("kind"))
    angry = m.filter("m.notificationType = 'Complaint'").select(F.explode("m.complaint.complainedRecipients.emailAddress").alias("address"), F.lit("complaint").alias("kind"))
    return gone.unionByName(angry).distinct()


def token_sum(metadata: Column) -> Column:
    """Sum of total_tokens in JSON that is one object or a list of them."""
    many = F.coalesce(F.from_json(metadata, "array<struct<total_tokens: long>>"), F.array())
    one = F.from_json(metadata, "total_tokens long")["total_tokens"]
    return F.when(F.ltrim(metadata).startswith("["), F.aggregate(many, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["total_tokens"], F.lit(0).cast("long")))).otherwise(F.coalesce(one, F.lit(0).cast("long")))


def meeting_summary(df: DataFrame, key: str, name: str, study: str, order: str) -> DataFrame:
    """key, summary: the names of a meeting's studies, else of all its activities, in order, as an English list (A36). A
    meeting has some activities."""
    from quorumlake.functions.text import english_list

    all_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(study).alias("s"), F.col(name).alias("n"))))
    picked = df.groupBy(key).agg(F.bool_or(study).alias("_any"), all_.alias("_a"))
    names = F.transform(F.filter("_a", lambda x: ~F.col("_any") | x["s"]), lambda x: x["n"])
    return picked.select(key, english_list(names).alias("summary"))


def committee_slug(short_name: Column, parent: Column) -> Column:
    """Slug of a committee: letters and digits of its short name, behind that of its parent, at most 46 characters."""
    from quorumlake.functions.text import slug

    return F.left(F.concat_ws("-", parent, slug(short_name, digits=True)), F.lit(46))


def new_slugs(df: DataFrame, slug: str, taken: DataFrame) -> DataFrame:
    """`df` with `refused`: whether the slug is one of `taken` already, as a person's slug is never changed for it."""
    return df.join(taken.select(F.col(slug)).distinct().withColumn("refused", F.lit(True)), slug, "left").na.fill(False, ["refused"])


def unique_slugs(df: DataFrame, base: str, *order: Column) -> DataFrame:
    """`slug`: the base, with -2, -3 … for later rows of the same base."""
    rn = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn("slug", F.when(rn > 1, F.concat_ws("-", base, rn.cast("string"))).otherwise(F.col(base)))


def opaque_urls(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(df with links replaced by tokens, table token -> url): a token is a hash of the url, so equal urls share one and the
    way back is a join (F27)."""
    urls = df.select(F.explode(F.regexp_extract_all(text, F.lit(r"\]\(([^)]+)\)"), 1)).alias("url")).distinct()
    table = urls.withColumn("token", F.concat(F.lit("u"), F.substring(F.sha1("url"), 1, 12)))
    found = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"\]\(([^)]+)\)"), 1)).alias("url")).join(table, "url")
    maps = found.groupBy(key).agg(F.collect_set(F.struct("url", "token")).alias("_m"))  # the links of one text
    swap = F.expr(f"aggregate(coalesce(_m, array()), `{text}`, (t, x) -> replace(t, concat('](', x.url, ')'), concat('](', x.token, ')')))")
    return df.join(maps, key, "left").withColumn(text, swap).drop("_m"), table


def linked(df: DataFrame, key: str, content: str, targets: DataFrame) -> DataFrame:
    """`content` with <a … data-HoCid="n" …> given the href of `targets` (hocid, url) where there is one (F25). The ids of a text
    are exploded, joined and put back as a map, so the table of targets is never held by a task."""
    ids = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit(r'<a [^>]*data-HoCid="(\d+)"'), 1))).alias("hocid"))
    got = ids.join(targets.select(F.col("hocid").cast("string"), "url"), "hocid").groupBy(key).agg(F.collect_list(F.struct("hocid", "url")).alias("_l"))
    put = F.expr(f"""aggregate(coalesce(_l, array()), `{content}`, (t, x) -> replace(t, concat('data-HoCid="', x.hocid, '"'), concat('data-HoCid="', x.hocid, '" href="', x.url, '"')))""")
    return df.join(got, key, "left").withColumn(content, put).drop("_l")


# --- stems: endings are taken off in steps by the measure of the stem before them (the algorithm published by Porter, 1980) ----

_V = re.compile(r"[aeiou]|(?<=[^aeiou])y")
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
          "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    return "".join("v" if ch in "aeiou" or ch == "y" and i and w[i - 1] not in "aeiou" else "c" for i, ch in enumerate(w))


def _measure(w: str) -> int:
    return len(re.findall(r"v+c+", _shape(w)))


def _short(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def stem(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz":
            w = cut[:-1]
        elif _measure(cut) == 1 and _short(cut):
            w = cut + "e"
        else:
            w = cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stems(s: pd.Series) -> pd.Series:
    """Stem of each word: meant for the distinct terms of an index, not for texts."""
    return s.map(lambda x: None if x is None else stem(x))
