"""Mixing sources to target shares of all tokens, by capped water-filling (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.session import written

#: Buckets of the seeded order in which a source's texts are drawn; only the bucket where the quota ends is ordered row by row.
BUCKETS = 4096
#: What is left of a quota below so many tokens is filled by sizes, so at most so many different sizes reach the driver.
FINISH = 100_000
#: The total at which every source that has texts reaches its share.
EXACT = "exact"


def largest_total(tokens: dict[str, int], share: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest total at which no source that has texts needs more than its repeats allow."""
    have = {s: w for s, w in share.items() if w > 0 and tokens.get(s, 0) > 0 and repeats[s] > 0}
    weight = sum(have.values())
    return min((tokens[s] * repeats[s] / (w / weight) for s, w in have.items()), default=0.0)


def water_fill(tokens: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Tokens to take of each source: its share of `total`, clamped at tokens * repeats; what a clamped source can't give
    goes to the others in proportion to their shares, until nothing more is clamped. Where all are clamped the sum stays
    below the total."""
    goal = dict.fromkeys(share, 0.0)
    free = {s: w for s, w in share.items() if w > 0}
    left = float(total)
    while free and left > 0:
        weight = sum(free.values())
        full = [s for s, w in free.items() if left * w / weight >= tokens.get(s, 0) * repeats[s]]
        if not full:
            for s, w in free.items():
                goal[s] = left * w / weight
            break
        for s in full:
            goal[s] = float(tokens.get(s, 0) * repeats[s])
        left -= sum(goal[s] for s in full)
        for s in full:
            del free[s]
    return goal


def _prefix(pool: DataFrame, room: DataFrame, key: str) -> DataFrame:
    """`pool` with `_in`: 1 where a text lies within its source's room (a row per source) whole, in the seeded order of the
    texts that fit, 0 for the others that fit, -1 for those that don't."""
    pool = pool.join(F.broadcast(room), "source", "left").withColumn("_fits", F.coalesce(F.col("n_tokens") <= F.col("room"), F.lit(False)))
    fit = pool.filter("_fits")
    per = fit.groupBy("source", "_b", "room").agg(F.sum("n_tokens").alias("_n"))
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    # Buckets that end before the room does are in, those that begin after it out; the one between is ordered row by row.
    per = per.withColumn("_state", F.when(F.col("_before") + F.col("_n") <= F.col("room"), 1).when(F.col("_before") >= F.col("room"), 0).otherwise(2))
    placed = fit.join(F.broadcast(per.drop("_n", "room")), ["source", "_b"])  # at most sources x BUCKETS rows
    inside = Window.partitionBy("source", "_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter("_state = 2").withColumn("_in", (F.col("_before") + F.sum("n_tokens").over(inside) <= F.col("room")).cast("int"))
    flat = placed.filter("_state <> 2").withColumn("_in", F.col("_state"))
    cols = [key, "source", "n_tokens", "_h", "_b", "_in"]
    return flat.select(cols).unionByName(edge.select(cols)).unionByName(pool.filter("not _fits").withColumn("_in", F.lit(-1)).select(cols))


def _filled(pool: DataFrame, left: dict[str, float], key: str) -> DataFrame:
    """Texts of `pool` that fill what is `left` of each source: from the largest size that fits down, of equal sizes in the
    seeded order, until none fits."""
    room = pool.sparkSession.createDataFrame(list(left.items()), "source string, room double")
    fit = pool.join(F.broadcast(room), "source").filter("n_tokens <= room")
    sizes: dict[str, list[tuple[int, int]]] = {}
    for r in fit.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r.source, []).append((r.n_tokens, r.n))
    take: list[tuple[str, int, int]] = []
    for s, own in sizes.items():
        free = left[s]
        for size, n in sorted(own, reverse=True):
            k = min(n, int(free // size))
            free -= k * size
            if k:
                take.append((s, size, k))
    wanted = pool.sparkSession.createDataFrame(take, "source string, n_tokens long, k long")
    most = max((k for _, _, k in take), default=0)
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy("_h", key))
    some = fit.join(F.broadcast(wanted), ["source", "n_tokens"]).withColumn("_r", rank)
    return some.filter((F.col("_r") <= most) & (F.col("_r") <= F.col("k"))).select(key, "source", "n_tokens")


def mix(sizes: DataFrame, weights: DataFrame, *, key: str = "doc_id", total: float | str | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(selection, report). selection: key, source, copies, n_tokens, the whole and the drawn fractional repetition in one
    count; report: source, target_share, max_repeats, available_tokens, goal_tokens, taken_tokens, reached_share, epochs.

    `total` is the number of tokens wanted. None takes all tokens of the sources once: sources that have too little are
    clamped at their repeats and the others get the rest, so the shares reached are reported beside the targets. EXACT takes
    the largest total at which no source that has texts is clamped, so each reaches its share (those of sources without texts
    are spread over the others in proportion). A source's fraction is drawn in the order of a seeded hash; texts larger than
    what is left of the quota are passed over, and what is left at the end, less than FINISH tokens or a fiftieth of the
    fraction, is filled from the largest texts that fit, until none does. So its tokens are right but for less than the
    smallest text left, however skewed the sizes. Sources without a weight (or a null source), texts without tokens and
    repeats below 1 give nothing. Repeated weight rows count once, and so do repeated rows of a text and source. Weights are
    a setting: one row per source, so they and the sums per source reach the driver."""
    kinds = weights.filter("source is not null and target_share > 0").groupBy("source").agg(
        F.max("target_share").alias("w"), F.max("max_repeats").alias("r")
    ).collect()
    share = {r.source: r.w for r in kinds}
    repeats = {r.source: max(0, r.r or 0) for r in kinds}
    spark = sizes.sparkSession
    wanted = spark.createDataFrame([(s,) for s in share], "source string")
    rows = sizes.filter("n_tokens > 0").join(F.broadcast(wanted), "source").groupBy(key, "source").agg(F.max("n_tokens").alias("n_tokens"))
    rows = written(rows, "p8-sizes")
    tokens = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    if total is None:
        total = float(sum(tokens.values()))
    elif total == EXACT:
        total = largest_total(tokens, share, repeats)
    goal = water_fill(tokens, share, repeats, total)
    plan = []
    for s, g in goal.items():
        a = tokens.get(s, 0)
        whole = min(repeats[s], int(g // a)) if a else 0
        part = 0.0 if not a or whole >= repeats[s] else g - whole * a
        plan.append((s, share[s], repeats[s], a, g, whole, part))
    plan = spark.createDataFrame(
        plan, "source string, target_share double, max_repeats int, available_tokens long, goal_tokens double, whole int, part double"
    )
    order = F.xxhash64(F.lit(seed), F.col(key))
    drawn = rows.withColumn("_h", order).withColumn("_b", F.pmod(F.shiftright("_h", 7), F.lit(BUCKETS)).cast("int"))
    pool = drawn.select(key, "source", "n_tokens", "_h", "_b")
    first = room = {r.source: r.part for r in plan.collect()}
    settled: list[DataFrame] = []
    left: dict[str, float] = {}
    rest: list[DataFrame] = []
    while room:
        pool = written(_prefix(pool, spark.createDataFrame(list(room.items()), "source string, room double"), key), "p8-drawn")
        settled.append(pool.filter("_in = 1").select(key, "source", "n_tokens"))
        got = {r.source: r.n for r in pool.filter("_in = 1").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        left |= {s: room[s] - got.get(s, 0) for s in room}
        # Where nothing was taken no text fits; where little is left the rest is filled by sizes.
        room = {s: left[s] for s in got if left[s] > max(FINISH, first[s] * 0.02)}
        pool = pool.filter("_in = 0").drop("_in")
        rest.append(pool.filter(~F.col("source").isin(list(room))))
    taken = rows.select(key, "source", "n_tokens").limit(0)
    for part in settled:
        taken = taken.unionByName(part)
    if rest:
        undrawn = rest[0]
        for part in rest[1:]:
            undrawn = undrawn.unionByName(part)
        taken = taken.unionByName(_filled(undrawn, left, key))
    used = taken.select(key, "source", "n_tokens", F.lit(1).alias("copies"))
    repeated = rows.join(F.broadcast(plan.select("source", "whole").filter("whole > 0")), "source").select(key, "source", "n_tokens", F.col("whole").alias("copies"))
    # A text may be repeated whole and drawn for the fraction: its uses are added.
    uses = repeated.unionByName(used).groupBy(key, "source").agg(F.sum("copies").cast("int").alias("copies"), F.max("n_tokens").alias("n_tokens"))
    selection = written(uses.select(key, "source", "copies", "n_tokens"), "p8-selection")
    sums = selection.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("taken_tokens"))
    report = plan.join(sums, "source", "left").na.fill(0, ["taken_tokens"])
    everything = Window.partitionBy(F.lit(1))  # over one row per source
    report = report.select(
        "source", "target_share", "max_repeats", "available_tokens", "goal_tokens", "taken_tokens",
        F.try_divide(F.col("taken_tokens"), F.sum("taken_tokens").over(everything)).alias("reached_share"),
        F.coalesce(F.try_divide(F.col("taken_tokens"), F.col("available_tokens")), F.lit(0.0)).alias("epochs"),
    )
    return selection, report
