"""Values cut off by field limits or in transfer (problem 1).

Per source and field a mixture of log-normals is fitted to the value lengths by maximum likelihood, with the values that
sit on a candidate limit as right-censored observations (`fit_limits`). That gives each value on a limit a censoring
posterior; values elsewhere get the source's rate of cuts in mid transfer. Both are the priors of a two-class model over
how a value ends (`ENDINGS`), whose class probabilities and rates are estimated by expectation-maximisation on the counts
of (source, field, limit, ending). The ending is judged against the corpus: brackets left open, a last word that elsewhere
never ends a value, a last word that is the beginning of a word seen after the same predecessor.

Every step but the fits is plain column work over distinct values; a fit sees one histogram per source and field.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.session import written

#: How a value may end, from the strongest sign of a cut to none.
ENDINGS = ("mark", "open", "dangling", "extended", "never", "unknown", "final")
COMPONENTS, ROUNDS = 4, 60
#: A length is tried as a limit if that many distinct values have it, and so many times the mean of its neighbours.
SPIKE_MIN, SPIKE_TIMES = 5, 3.0
LIMIT_WEIGHT = 3.0
#: Values so many times as long as the longest candidate count as that long.
BEYOND = 8
#: Twice the gain in log likelihood that a limit must bring.
GAIN = 12.0
_FITS = "source string, field string, measure string, len int, q double, share double, gain double"


def _pmf(grid: np.ndarray, mu: np.ndarray, sd: np.ndarray, mix: np.ndarray) -> np.ndarray:
    x = np.log(grid)[None, :]
    d = np.exp(-0.5 * ((x - mu[:, None]) / sd[:, None]) ** 2) / (sd[:, None] * grid[None, :])
    return mix[:, None] * d / np.maximum(d.sum(1, keepdims=True), 1e-300)


def fit_limits(lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, float, float, float]]:
    """(length, censoring posterior q, share of the longer values that were cut, gain) for each limit found.

    `counts` are numbers of distinct values per length. A limit L may apply to a part `share` of the values only (a limit
    that was raised later): a value of length L is cut with odds share * P(longer) : P(L)."""
    own = dict(zip(lengths.tolist(), counts.tolist()))
    near = lambda i: np.array([own.get(k, 0.0) for k in (*range(max(1, i - 4), i), *range(i + 1, i + 5))])
    cand = [x for x, k in own.items() if k >= SPIKE_MIN and k > SPIKE_TIMES * max(near(x).mean(), 0.7)]
    if not cand:
        return []
    # How far beyond the last candidate a value reaches tells nothing of the limits: a single text of any length makes no grid.
    lengths = np.minimum(lengths, BEYOND * max(cand))
    top = int(lengths.max())
    n = np.zeros(4 * top + 2)
    np.add.at(n, lengths, counts)
    grid = np.arange(1, len(n))
    w = n[1:]
    total = w.sum()
    lx = np.log(grid)
    cut = np.cumsum(w) / total
    mu = np.array([lx[np.searchsorted(cut, p)] for p in (np.arange(COMPONENTS) + 0.5) / COMPONENTS])
    sd, mix = np.full(COMPONENTS, 0.35), np.full(COMPONENTS, 1 / COMPONENTS)
    q = dict.fromkeys(cand, 0.8)
    share = dict.fromkeys(cand, 0.5)
    for _ in range(ROUNDS):
        part = _pmf(grid, mu, sd, mix)
        f = part.sum(0) + 1e-12
        full = w.copy()
        for c in cand:  # the censored mass lies somewhere beyond c
            beyond = f[c:]
            s = beyond.sum()
            q[c] = share[c] * s / (share[c] * s + f[c - 1])
            full[c - 1] -= q[c] * w[c - 1]
            full[c:] += q[c] * w[c - 1] * beyond / s
            share[c] = min(1.0, q[c] * w[c - 1] / max(q[c] * w[c - 1] + w[c:].sum(), 1e-9))
        resp = part / f * full
        mass = resp.sum(1) + 1e-9
        mix = mass / mass.sum()
        mu = (resp @ lx) / mass
        sd = np.sqrt(np.maximum((resp * (lx[None, :] - mu[:, None]) ** 2).sum(1) / mass, 0.05**2))
    f = _pmf(grid, mu, sd, mix).sum(0) + 1e-12
    out = []
    for c in cand:
        s = f[c:].sum()
        with_limit = w[c - 1] * np.log(f[c - 1] + share[c] * s) + w[c:].sum() * np.log(max(1 - share[c], 1e-9))
        gain = 2 * (with_limit - w[c - 1] * np.log(f[c - 1]))
        if gain > GAIN:
            out.append((c, float(q[c]), float(share[c]), float(gain)))
    return out


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = fit_limits(pdf["len"].to_numpy(), pdf["n"].to_numpy(float))
    head = pdf.iloc[0]
    return pd.DataFrame(
        [(head["source"], head["field"], head["measure"], *r) for r in rows],
        columns=["source", "field", "measure", "len", "q", "share", "gain"],
    )


def _plain(tok: Column) -> Column:
    return F.regexp_replace(tok, r"^[\p{Punct}”’]+|[\p{Punct}”’]+$", "")


def _shape(values: DataFrame) -> DataFrame:
    """Adds what of the ending needs no corpus: stem, mark, brackets, words."""
    stem = F.regexp_replace("v", r"[\s ]*(\.\.\.|…|(?<=[\p{L},(\s])-)[\s ]*$", "")
    shaped = values.withColumn("stem", stem).withColumn("mark", F.length("stem") < F.length("v"))
    # A word after a comma is told from the same word elsewhere: "Promotion" ends no value, "…, Promotion" may.
    lowered = F.regexp_replace(F.lower("stem"), r",[\s ]+", " ,")
    words = F.filter(
        F.transform(F.split(lowered, r"[\s —(\[]+"), lambda x: F.concat(F.when(x.startswith(","), ",").otherwise(""), _plain(x))),
        lambda x: ~x.isin("", ","),
    )
    opened = F.length(F.regexp_replace("stem", r"[^(\[]", "")) > F.length(F.regexp_replace("stem", r"[^)\]]", ""))
    return shaped.select(
        "*", words.alias("words"), opened.alias("open"), F.col("stem").rlike(r"[,(\[—&/][\s ]*$").alias("dangling")
    ).select(
        "*",
        F.coalesce(F.try_element_at("words", F.lit(-1)), F.lit("")).alias("last"),
        F.coalesce(F.try_element_at("words", F.lit(-2)), F.lit("")).alias("prev"),
        F.regexp_extract(F.lower("stem"), r",[\s ]*([^,]+)$", 1).alias("segment"),
    )


def _endings(values: DataFrame) -> DataFrame:
    """values (source, field, v, n, on_limit) with `ending`. Words are learned from values that are neither marked nor
    on a limit; a value counts with the number of its rows."""
    shaped = _shape(values)
    good = shaped.filter(~F.col("mark") & ~F.col("on_limit") & ~F.col("open") & ~F.col("dangling") & (F.size("words") > 0))
    words = good.groupBy("field", "words").agg(F.sum("n").alias("n"))
    occ = words.select(
        "field", "n", F.size("words").alias("k"), F.posexplode("words").alias("i", "w"), "words"
    ).select(
        "field", "n", "w", F.when(F.col("i") > 0, F.try_element_at("words", F.col("i"))).otherwise("").alias("p"),
        (F.col("i") == F.col("k") - 1).cast("long").alias("is_last"),
    )
    pairs = occ.groupBy("field", "p", "w").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_last")).alias("ends"))
    single = pairs.groupBy("field", "w").agg(F.sum("n").alias("w_n"), F.sum("ends").alias("w_ends"))
    longer = (
        pairs.filter(F.length("w") > 1)
        .join(single, ["field", "w"])
        .select("field", "p", F.col("w_n").alias("n"), F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> left(w, i))")).alias("w"))
        .groupBy("field", "p", "w")
        .agg(F.max("n").alias("longer_n"))
    )
    ends = shaped.select("field", F.col("prev").alias("p"), F.col("last").alias("w")).distinct()
    judged = ends.join(single, ["field", "w"], "left").join(longer, ["field", "p", "w"], "left")
    n, e, more = (F.coalesce(c, F.lit(0)) for c in ("w_n", "w_ends", "longer_n"))
    # A last part (after the comma) that elsewhere stands whole before a comma is whole: parts may be in either order.
    parts = good.select("field", F.regexp_extract(F.lower("stem"), r"^([^,]+),", 1).alias("segment"), "n")
    parts = parts.filter("segment <> ''").groupBy("field", "segment").agg(F.sum("n").alias("part_n"))
    judged = judged.select(
        "field", F.col("p").alias("prev"), F.col("w").alias("last"),
        F.when((more > 0) & ((n <= 3) & (n < more + 2) | (n < 0.1 * more)), "extended")
        .when((n - e >= 5) & (e < 0.03 * n), "never")
        .when(n - e >= 2 * e + 2, "unknown")
        .when(e >= 2, "final").otherwise("unknown").alias("word"),
    )
    ending = (
        F.when(F.col("mark"), "mark").when(F.col("open"), "open").when(F.col("dangling"), "dangling").otherwise(F.col("word"))
    )
    told = shaped.join(judged, ["field", "prev", "last"], "left").join(parts, ["field", "segment"], "left")
    whole = (F.col("part_n") >= 3) & (F.col("word") != "extended")
    closed = F.col("stem").rlike(r"[)\].]\s*$") | F.coalesce(whole, F.lit(False))
    told = told.withColumn("word", F.when(closed, "final").otherwise(F.col("word")))
    return told.select(*values.columns, F.coalesce(ending, F.lit("unknown")).alias("ending"))


def _em(table: pd.DataFrame) -> pd.DataFrame:
    """Posterior of a cut per (source, field, len, ending): priors q on limits, a rate per source and field elsewhere."""
    code = table["ending"].map({e: i for i, e in enumerate(ENDINGS)}).to_numpy()
    n = table["n"].to_numpy(float)
    limit = table["q"].notna().to_numpy()
    q = table["q"].fillna(0).clip(0.02, 0.995).to_numpy()
    group, _ = pd.factorize(table["source"] + "\0" + table["field"])
    rate = np.full(group.max() + 1, 0.01)
    at, _ = pd.factorize(table["source"] + "\0" + table["field"] + "\0" + table["len"].astype(str))
    first = q.copy()
    cut = np.array([0.2, 0.2, 0.15, 0.25, 0.1, 0.05, 0.05])
    whole = np.array([1e-4, 1e-3, 1e-3, 5e-3, 5e-3, 0.1, 0.88])
    for _ in range(50):
        prior = np.where(limit, q, rate[group])
        post = prior * cut[code]
        post = post / (post + (1 - prior) * whole[code])
        c, w = (np.bincount(code, n * x, len(ENDINGS)) + 0.5 for x in (post, 1 - post))
        cut, whole = c / c.sum(), w / w.sum()
        # No sign of a cut may become one by drift: their ratios stay on their side of one.
        cut[:4], whole[:4] = np.maximum(cut[:4], 3 * whole[:4]), np.minimum(whole[:4], cut[:4] / 3)
        cut[5], cut[6] = min(cut[5], 2 * whole[5]), min(cut[6], 0.1 * whole[6])
        # The endings on a limit say how far it is one: its share is re-estimated, the fit counting as LIMIT_WEIGHT values.
        own = np.bincount(at, n * post)[at], np.bincount(at, n)[at]
        q = np.where(limit, (own[0] + LIMIT_WEIGHT * first) / (own[1] + LIMIT_WEIGHT), q).clip(0.001, 0.995)
        free = ~limit
        size = np.bincount(group[free], n[free], len(rate))
        rate = (np.bincount(group[free], (n * post)[free], len(rate)) + 0.02) / (size + 20)
        rate = np.clip(rate, 1e-4, 0.3)
    return table.assign(posterior=post)


def find_truncated(
    df: DataFrame, *, key: str, source: str, fields: list[str], threshold: float = 0.5
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cut, report, limits): cut has key, field_name, value, posterior of every value judged cut; report has per source
    and field the number of values, of cut ones and their share; limits the limits found.

    Null and empty values are never cut and aren't counted; rows repeated with equal key, source and values count once. A
    null source is a source of its own, named ''. Values of any length are treated whole. An empty table gives none."""
    rows = df.select(
        F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("source"), *[F.col(f) for f in fields]
    ).distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields]))
    long = rows.select("key", "source", pairs.alias("p")).select("key", "source", "p.field", "p.v").filter("v <> ''")
    values = written(long.groupBy("source", "field", "v").agg(F.count("*").alias("n")), "p1-values")

    sized = values.select(
        "source", "field",
        F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.length("v").alias("len")),
                          F.struct(F.lit("bytes").alias("measure"), F.octet_length("v").alias("len")))).alias("m"),
    )
    hist = sized.groupBy("source", "field", "m.measure", "m.len").agg(F.count("*").alias("n"))
    fits = written(hist.groupBy("source", "field", "measure").applyInPandas(_fit, _FITS), "p1-fits")
    gains = fits.groupBy("source", "measure").agg(F.sum("gain").alias("gain"))  # a source counts in one unit
    best = gains.groupBy("source").agg(F.max_by("measure", F.struct("gain", "measure")).alias("measure"))
    limits = fits.join(best, ["source", "measure"])  # a handful of rows per source and field

    length = F.when(F.col("measure") == "bytes", F.octet_length("v")).otherwise(F.length("v"))
    marked = (
        values.join(best, "source", "left")
        .withColumn("len", length)
        .join(limits.select("source", "field", "len", "q"), ["source", "field", "len"], "left")
        .select("source", "field", "v", "n", F.when(F.col("q").isNotNull(), F.col("len")).otherwise(-1).alias("len"), "q",
                F.col("q").isNotNull().alias("on_limit"))
    )
    ended = written(_endings(marked), "p1-ended")
    # Sources x fields x limits x seven endings: its size follows the number of sources, not of values.
    counts = ended.groupBy("source", "field", "len", "q", "ending").agg(F.sum("n").alias("n")).toPandas()
    schema = "source string, field string, len int, ending string, posterior double"
    spark = df.sparkSession
    if len(counts):
        post = spark.createDataFrame(_em(counts)[["source", "field", "len", "ending", "posterior"]], schema)
    else:
        post = spark.createDataFrame([], schema)
    scored = ended.join(post, ["source", "field", "len", "ending"])
    cut_values = scored.filter(F.col("posterior") >= threshold).select("source", "field", "v", "posterior")
    cut = long.join(cut_values, ["source", "field", "v"]).groupBy("key", F.col("field").alias("field_name")).agg(
        F.max_by("v", "posterior").alias("value"), F.max("posterior").alias("posterior")
    ).withColumnRenamed("key", key)
    report = scored.groupBy("source", F.col("field").alias("field_name")).agg(
        F.sum("n").alias("n_values"),
        F.sum(F.when(F.col("posterior") >= threshold, F.col("n")).otherwise(0)).alias("n_cut"),
    ).withColumn("cut_share", F.col("n_cut") / F.col("n_values")).withColumnRenamed("source", source)
    return cut, report, limits
