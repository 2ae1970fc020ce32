"""Text statistics per document, outlier scores and the form of a text (problem 9).

`text_statistics` computes the statistics of whole texts as Column expressions, so no text leaves the JVM.
`tail_probabilities` gives each value its exact rank within the language: equal values are first counted, the distinct
values are sorted by range partitioning, and the sums of the partitions before give each partition its offset. Distinct
texts are ranked, so that a text isn't taken for usual because it is repeated; a language of few texts is ranked within
the whole corpus.

Each form has the statistics whose tails it lies in (`SIGNS`). A list or a table must lie in all its tails, so its outlier
score is three times the least -ln tail probability; unreadable text comes in kinds, so its score is the sum of the three
largest. The scores choose: a text that none sets apart is prose. An exact check follows, since in a corpus without a form
the most unusual prose has its ranks: a list or table must be what makes up most of the text (`MOST` of its characters),
and junk mustn't read as sentences do (`READS`). What isn't rare in its language is no outlier: a form that a share f of
the distinct texts of a language has scores 3 ln(1/f), so a list or table is found while f is below about 0.3, junk while
each of its kinds is below about 0.13.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.session import written

# The most common function words of English and French; elided ones without the apostrophe.
COMMON = {
    "en": """the of and to a in is that for on with as by at this it from be are was were has have had will would not or an we our
        i my you your they their his her he she its which who what when where how there but no all more than may shall can could
        do does before after about between into over under been if so because then says said any each only other these those
        us them me""",
    "fr": """le la les l de des du d et à a au aux un une en que qu qui dans pour par sur est sont été être était ne pas n se s ce
        c cette ces son sa ses leur leurs il elle ils elles nous vous je j on mon ma mes notre nos votre vos avec sans plus ou où
        mais si comme dont y ont avait sera seront peut quand avant après entre même tout tous toute toutes lui""",
}

#: Form -> its statistics and the side (1: large values, -1: small ones) on which it lies.
SIGNS = {
    "list": {"item_share": 1, "open_share": 1},
    "table": {"row_share": 1, "cell_ratio": 1, "digit_ratio": 1},
    "junk": {"clean_share": -1, "symbol_ratio": 1, "common_share": -1, "mean_word_len": 1, "sentence_words": 1, "vocabulary": -1, "tag_share": 1},
}
#: Least score of an outlier, by form: the sum of three tails.
BARS = {"list": 3.6, "table": 3.6, "junk": 6.0}
#: Share of the characters that a list or table must hold.
MOST = 0.5
#: Least share of clean words, least share of common words (where the language's are known) and most words a sentence of a text that reads.
READS = (0.9, 0.3, 40)
#: A language of fewer distinct texts is ranked within the whole corpus.
GROUP_MIN = 200
#: Ranks of distinct values that are sent to every task, some 40 bytes each.
SENT = 1_000_000
#: Parts into which each value of the ranks is dealt when they are joined back: a third of all texts may share one value.
SALTS = 16

_BULLET = r"^(?:[-*•‣▪◦–+]\s|\[[ xX✓]?\]|[A-Z]-\d+\s)"
_MARK = r"^(?:\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s|\([ivx]+\)\s|§\s*\d)"
_LEADER = r"(?:\.\s?){4,}\s*\d+$"
_CELL = r"[\t|]|[;,](?=\S)|[  ]{2,}+(?=\S)"
_END = r"[.!?…:][\"'»”)]*$"
_STOP = r"[.!?…][\"'»”)]*(?=\s|$)"
_TAG = r"<[a-zA-Z/][^<>]*>|&[a-z]+;|\{\{|\}\}"
_ONE = r"(?:[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿœ]++|[A-ZÀ-ÖØ-ÞŒ]++)"
#: A piece of a line, and one written as words or numbers are.
_PIECE = r"[^\s,;|]+"
_CLEAN = (
    rf"(?<![^\s,;|])(?:[\"'«»“”‘’(\[]*+{_ONE}(?:['’—–-]{_ONE})*+[\"'«»“”‘’)\].:!?…%]*+"
    r"|[($€£#]*+[-+]?\d[\d.:/-]*+[%).:!?]*+|[–—-]++|[.:!?«»]++)(?![^\s,;|])"
)

_STATS = [
    "words", "mean_word_len", "symbol_ratio", "end_punct_share", "common_share", "clean_share", "vocabulary", "tag_share", "digit_ratio",
    "sentence_words", "line_words", "open_share", "item_share", "row_share", "cell_ratio",
]


def bar(form: str, n: Column) -> Column:
    """The score of `form` that stands out among n distinct texts: its bar, or less where a text that is the first in two
    statistics can't reach it."""
    return F.round(F.least(F.lit(BARS[form]), 2 * F.log(n)), 6)


def text_statistics(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """key, the statistics of each text, rounded to four decimals, lang_group and `_text`, which is equal for equal texts of
    one language. Null counts as empty, and an empty text has all statistics 0. lang_group is the first two letters of the
    tag, or where there is none the language whose common words are most frequent, English where none are."""
    en, fr = (v.split() for v in COMMON.values())
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.lower(F.trim(F.coalesce(F.col(lang), F.lit("")))).alias("la"))
    # A line that goes on in small letters is one with the line before it.
    joined = F.split(F.regexp_replace("t", r"(?<=[\p{L},]) ?\n(?=\p{Ll})", " "), "\n")
    count = lambda x, pattern: F.regexp_count(x, F.lit(pattern))
    cut = rows.select(
        "*",
        F.filter(F.split(F.lower("t"), r"[^\p{L}]+"), lambda w: w != "").alias("low"),
        F.transform(
            F.filter(F.transform(joined, lambda x: F.btrim(x, F.lit(" \t\r "))), lambda x: x != ""),
            # Pieces are what stands between blanks and cell marks; counted in one pass over the line each.
            lambda x: F.struct(x.alias("x"), F.length(x).alias("len"), count(x, _PIECE).alias("n"), count(x, _CLEAN).alias("clean"), count(x, _CELL).alias("cells"), x.rlike(_END).alias("ended")),
        ).alias("cut"),
        (F.length("t") - count("t", r"\s")).alias("chars"),
    )
    # A text tagged with one of the two languages is asked for its words only.
    hits = lambda words, other: F.when(F.col("la").startswith(other), 0).otherwise(F.size(F.filter("low", lambda w: w.isin(words))))
    cut = cut.withColumn("en", hits(en, "fr")).withColumn("fr", hits(fr, "en"))

    def kind(x: Column) -> Column:
        """'r' row of cells, 'i' item, '' neither, of lines that read like words and figures."""
        t, n, short = x["x"], x["n"], x["n"] <= 8
        parts = F.split(t, r",\s+")  # a run of names or phrases is a list, a run of loose words isn't
        named = F.size(F.filter(parts, lambda y: y.rlike(r"^[\p{Lu}\d]|\s")))
        run = ~short & (F.size(parts) > 0.2 * n) & (named >= 0.6 * F.size(parts))
        item = short & ~x["ended"] | t.rlike(_BULLET) | t.rlike(_LEADER) | (short | ~x["ended"]) & t.rlike(_MARK) | run
        return F.when(x["clean"] < 0.6 * n, "").when(x["cells"] >= 0.2 * n, "r").when(item, "i").otherwise("")

    lines = F.transform("cut", lambda x: F.struct(x["len"].alias("len"), x["n"].alias("n"), x["clean"].alias("clean"), x["cells"].alias("cells"), x["ended"].alias("ended"), kind(x).alias("kind")))
    cut = cut.select("_key", "t", "la", "en", "fr", "low", "chars", lines.alias("lines"))
    total = lambda f: F.aggregate("lines", F.lit(0), lambda a, x: a + f(x))
    n, nlow, nlines, chars, whole = total(lambda x: x["n"]), F.size("low"), F.size("lines"), F.col("chars"), total(lambda x: x["len"])
    group = F.when(F.col("la") != "", F.substring("la", 1, 2)).when(F.col("fr") > F.col("en"), "fr").otherwise("en")
    common = F.when(F.col("lang_group") == "en", F.col("en")).when(F.col("lang_group") == "fr", F.col("fr")).otherwise(F.col("en") + F.col("fr"))
    part = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tagged = F.col("t").contains("<") | F.col("t").contains("&") | F.col("t").contains("{{")
    stats = {
        "words": n.cast("long"),
        "mean_word_len": part(chars, n),
        "symbol_ratio": part(count("t", r"[^\p{L}\p{N}\s.,;:!?'’\"“”()%«»–—$-]"), chars),
        "end_punct_share": part(total(lambda x: x["ended"].cast("int")), nlines),
        "common_share": part(common, nlow),
        "clean_share": part(total(lambda x: x["clean"]), n),
        "vocabulary": part(F.log1p(F.size(F.array_distinct("low"))), F.log1p(nlow)),  # falls little with the length of prose
        "tag_share": F.when(tagged, part(chars - F.length(F.regexp_replace("t", rf"{_TAG}|\s+", "")), chars)).otherwise(0.0),
        "digit_ratio": part(count("t", r"\d"), chars),
        "sentence_words": part(n, F.greatest(F.lit(1), count("t", _STOP))),
        "line_words": part(n, nlines),
        "open_share": part(total(lambda x: F.when(x["ended"], 0).otherwise(x["len"])), whole),
        "item_share": part(total(lambda x: F.when(x["kind"] == "i", x["len"]).otherwise(0)), whole),
        "row_share": part(total(lambda x: F.when(x["kind"] == "r", x["len"]).otherwise(0)), whole),
        "cell_ratio": part(total(lambda x: x["cells"]), n),
    }
    mark = F.unhex(F.md5(F.concat_ws(":", group, "t").cast("binary")))
    return cut.withColumn("lang_group", group).select(F.col("_key").alias(key), *[stats[s].alias(s) for s in _STATS], "lang_group", mark.alias("_text"))


def tail_probabilities(stats: DataFrame, key: str, group: str, names: list[str]) -> DataFrame:
    """key, grp, stat, low, high: the shares of the group's rows with a value not above, and not below, the row's own.

    Exact ranks by sorted partitions. Equal values are one row in the sort, so a value that a third of all rows share is no
    hot partition. The ranks of the distinct values go to every task if they are at most SENT, which is counted; beyond that
    they are joined by a shuffle in which each value is dealt into SALTS parts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value")) for n in names]))
    long = stats.select(key, F.col(group).alias("grp"), pairs.alias("p")).select(key, "grp", "p.stat", "p.value")
    counts = long.groupBy("grp", "stat", "value").agg(F.count("*").alias("n"))
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.repartitionByRange(parts, "grp", "stat", "value").sortWithinPartitions("grp", "stat", "value")
    ordered = written(ordered.withColumn("pid", F.spark_partition_id()), "p9-ranks")
    # One row per partition, language and statistic.
    sums = ordered.groupBy("grp", "stat", "pid").agg(F.sum("n").alias("part_n"))
    before = Window.partitionBy("grp", "stat").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp", "stat")
    sums = sums.select(
        "grp", "stat", "pid", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("offset"), F.sum("part_n").over(whole).alias("total")
    )
    inside = Window.partitionBy("pid", "grp", "stat").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ordered.withColumn("upto", F.sum("n").over(inside)).join(sums, ["grp", "stat", "pid"])
    at = F.col("offset") + F.col("upto")
    ranked = ranked.select("grp", "stat", "value", (at / F.col("total")).alias("low"), ((F.col("total") - at + F.col("n")) / F.col("total")).alias("high"))
    if ordered.count() <= SENT:
        return long.join(F.broadcast(ranked), ["grp", "stat", "value"]).select(key, "grp", "stat", "low", "high")  # counted
    ranked = ranked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    long = long.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return long.join(ranked, ["grp", "stat", "value", "salt"]).select(key, "grp", "stat", "low", "high")


def text_quality(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, the statistics, lang_group, the scores score_list, score_table, score_junk and form (prose, list, table, junk)
    of every document.

    An empty or null text, or one of white space, is junk: there is nothing to read. Keys should be unique; rows with a key
    of their own are judged by themselves. Other columns of `df` are ignored, whatever their names."""
    stats = written(text_statistics(df, key, text, lang), "p9-stats")
    used = list(dict.fromkeys(s for signs in SIGNS.values() for s in signs))
    # Equal texts of a language have equal statistics: they are ranked as one.
    texts = stats.filter("words > 0").select("_text", "lang_group", *used).distinct()
    sizes = texts.groupBy("lang_group").agg(F.count("*").alias("_n"))  # at most one row per pair of letters
    whole = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))
    sizes = sizes.crossJoin(F.broadcast(whole)).select("lang_group", (F.col("_n") < GROUP_MIN).alias("_few"), F.when(F.col("_n") < GROUP_MIN, F.col("_all")).otherwise(F.col("_n")).alias("_of"))  # one row
    placed = texts.join(F.broadcast(sizes), "lang_group")
    # The whole corpus is ranked too, as the group '*', if a language has few texts.
    also = placed.crossJoin(F.broadcast(sizes.agg(F.coalesce(F.bool_or("_few"), F.lit(False)).alias("_any")))).filter("_any")  # one row
    ranks = placed.filter("not _few").withColumn("_grp", F.col("lang_group")).select("_text", "_grp", *used).unionByName(
        also.select("_text", F.lit("*").alias("_grp"), *used)
    )
    own = placed.select("_text", F.when(F.col("_few"), "*").otherwise(F.col("lang_group")).alias("_own"), "_of")
    tails = tail_probabilities(ranks, "_text", "_grp", used)
    side = {s: d for signs in SIGNS.values() for s, d in signs.items()}
    sided = F.when(F.col("stat").isin([s for s, d in side.items() if d > 0]), F.col("high")).otherwise(F.col("low"))
    wide = tails.select("_text", F.col("grp").alias("_own"), "stat", (-F.log(sided)).alias("x")).groupBy("_text", "_own").agg(*[F.max(F.when(F.col("stat") == s, F.col("x"))).alias(f"_{s}") for s in used])
    told = {f: [F.col(f"_{s}") for s in signs] for f, signs in SIGNS.items()}
    top = lambda tails: F.aggregate(F.slice(F.sort_array(F.array(*tails), asc=False), 1, 3), F.lit(0.0), lambda a, x: a + x)
    by = {f: top(t) if len(t) > 3 else 3 * F.least(*t) for f, t in told.items()}
    scores = wide.select("_text", "_own", *[F.round(x, 6).alias(f"score_{f}") for f, x in by.items()])
    scores = own.join(scores, ["_text", "_own"]).drop("_own")
    scored = stats.join(scores, "_text", "left").na.fill(0.0, [f"score_{f}" for f in SIGNS])
    over = lambda f: F.col(f"score_{f}") >= bar(f, F.col("_of"))
    known = F.col("lang_group").isin(list(COMMON))
    reads = (F.col("clean_share") >= READS[0]) & (~known | (F.col("common_share") >= READS[1])) & (F.col("sentence_words") <= READS[2])
    form = (
        F.when(F.col("words") == 0, "junk")
        .when(over("table") & (F.col("row_share") > MOST), "table")
        .when(over("list") & (F.col("item_share") > MOST), "list")
        .when(over("junk") & ~reads, "junk")
        .otherwise("prose")
    )
    return scored.select(key, *_STATS, "lang_group", *[f"score_{f}" for f in SIGNS], form.alias("form"))
