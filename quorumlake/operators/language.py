"""N-gram frequency models, keyness against a background, keyword choice."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions.text import ngrams, words_of


# The stop words of the analysis, the general English ones and those of the chamber.
GENERAL = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
    a an the and but if or because as until while of at by for with about against between into through during before after above below to
    from up down in out on off over under again further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now""".split()  # fmt: skip
CHAMBER = """it's we're we'll they're can't won't isn't don't he's she's i'm aren't government house committee would speaker motion mr mrs ms member
    minister canada members time prime one parliament us bill act like canadians people said want could issue today hon order party canadian
    think also new get many say look country legislation law department two day days madam must that's okay thank really much there's yes no""".split()  # fmt: skip
STOP_WORDS = list(dict.fromkeys(GENERAL + CHAMBER))


def counts(df: DataFrame, keys: list[str], text: str, n: int, more_than: int = 2) -> DataFrame:
    """keys, gram, cnt of the n-grams of more than `more_than` characters and without '/', partial before the shuffle."""
    grams = df.select(*keys, F.explode(ngrams(words_of(F.col(text)), n)).alias("gram"))
    grams = grams.filter((F.length("gram") > more_than) & ~F.col("gram").contains("/"))
    return grams.groupBy(*keys, "gram").agg(F.count("*").alias("cnt"))


def shares(counted: DataFrame, keys: list[str], min_count: int = 1) -> DataFrame:
    """keys, gram, cnt, p: share of each n-gram of `counted` within its keys, summed over its other columns. The total behind p
    holds what min_count then drops; totals are one row per key and come from the counts, not from the texts."""
    own = counted.groupBy(*keys, "gram").agg(F.sum("cnt").alias("cnt"))
    totals = own.groupBy(*keys).agg(F.sum("cnt").alias("_total")) if keys else own.agg(F.sum("cnt").alias("_total"))
    got = own.join(totals, keys) if keys else own.crossJoin(F.broadcast(totals))  # one row
    return got.filter(F.col("cnt") >= min_count).select(*keys, "gram", "cnt", (F.col("cnt") / F.col("_total")).alias("p"))


def frequencies(df: DataFrame, keys: list[str], text: str, n: int, min_count: int = 1, more_than: int = 2) -> DataFrame:
    """The n-gram model of a table of texts: `shares` of its `counts`."""
    return shares(counts(df, keys, text, n, more_than), keys, min_count)


def item_counts(model: DataFrame, total: int) -> DataFrame:
    """`items`: how often each n-gram would stand among `total`, the share times the total rounded half to even."""
    return model.withColumn("items", F.bround(F.col("p") * total).cast("long"))


def keyness(model: DataFrame, background: DataFrame, stop: list[str], min_ratio: float = 2.0) -> DataFrame:
    """model with `score` = p - background p, without stop words and what is less than `min_ratio` times as frequent as in
    the background. The whole n-gram is compared with the stop words."""
    back = background.select("gram", F.col("p").alias("_bg"))
    got = model.join(back, "gram", "left").withColumn("_bg", F.coalesce("_bg", F.lit(0.0)))
    got = got.filter(~F.col("gram").isin(stop)) if stop else got
    return got.filter((F.col("_bg") == 0) | (F.col("p") / F.col("_bg") >= min_ratio)).withColumn("score", F.col("p") - F.col("_bg")).drop("_bg")


def choose_keywords(ranked: DataFrame, keys: list[str], stop: list[str] | None = None) -> DataFrame:
    """keys, gram, n, score of the accepted n-grams of `ranked` (keys, gram, n, score): longest first, then by score, a gram
    is accepted if neither its first nor its last word is a stop word or was in an accepted one. The fold sees at most some hundred rows per
    key, the top of each length."""
    kinds = dict(ranked.dtypes)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        seen = set(stop or ())
        keep = []
        for i, r in rows.sort_values(["n", "score", "gram"], ascending=[False, False, True]).iterrows():
            w = r["gram"].split(" ")
            if w[0] not in seen and w[-1] not in seen:
                keep.append(i)
                seen.update(w)
        return rows.loc[keep, [*keys, "gram", "n", "score"]]

    return ranked.select(*keys, "gram", "n", "score").groupBy(*keys).applyInPandas(
        fold, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["gram string", "n int", f"score {kinds['score']}"])
    )


