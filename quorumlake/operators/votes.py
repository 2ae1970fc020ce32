"""Party lines, disagreement and dissent of recorded ballots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order in which ballots win a tie (the tie has no defined order in the data).
TIE = ["Y", "N", "P", "A"]
#: A party is free ("F") where so great a share of its yeas and nays is on the smaller side.
FREE = 0.15


def party_lines(ballots: DataFrame, independent: int | DataFrame | None = None) -> DataFrame:
    """vote_id, party_id, vote, disagreement of `ballots` (vote_id, party_id, ballot).

    `independent`: the party whose members have no line, or a frame of one row with it. All ballots count in the mode, absences too; disagreement looks at yeas and nays and is 0 without any. One aggregate on
    (vote, party), with map-side partial counts: a vote of any size costs one row per task."""
    rows = ballots.filter("vote_id is not null and party_id is not null")
    if isinstance(independent, DataFrame):
        rows = rows.join(F.broadcast(independent.select("party_id")), "party_id", "left_anti")  # one row
    elif independent is not None:
        rows = rows.filter(F.col("party_id") != independent)
    n = {b: F.count_if(F.col("ballot") == b) for b in TIE}
    # Greatest count first, then the order of TIE.
    ranked = F.array(*[F.struct(n[b].alias("n"), F.lit(-i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate(TIE)])
    agg = rows.groupBy("vote_id", "party_id").agg(F.array_max(ranked)["b"].alias("mode"), n["Y"].alias("y"), n["N"].alias("n"))
    disagreement = F.coalesce(F.try_divide(F.least("y", "n"), F.col("y") + F.col("n")), F.lit(0.0))
    return agg.select(
        "vote_id", "party_id", F.when(disagreement >= FREE, "F").otherwise(F.col("mode")).alias("vote"), disagreement.alias("disagreement")
    )


def dissents(ballots: DataFrame, lines: DataFrame) -> DataFrame:
    """`ballots` with `dissent`: the ballot and the party's line are yea or nay and differ. Without a line there is none."""
    line = lines.select("vote_id", "party_id", F.col("vote").alias("_line"))
    against = F.col("ballot").isin("Y", "N") & F.col("_line").isin("Y", "N") & (F.col("ballot") != F.col("_line"))
    return ballots.join(line, ["vote_id", "party_id"], "left").withColumn("dissent", F.coalesce(against, F.lit(False))).drop("_line")


def totals_check(votes: DataFrame, ballots: DataFrame) -> DataFrame:
    """vote_id, stated and counted yeas and nays, small (fewer than a hundred stated), differs."""
    counted = ballots.groupBy("vote_id").agg(F.count_if(F.col("ballot") == "Y").alias("counted_y"), F.count_if(F.col("ballot") == "N").alias("counted_n"))
    got = votes.join(counted, "vote_id", "left").na.fill(0, ["counted_y", "counted_n"])
    return got.select(
        "vote_id", "yea_total", "nay_total", "counted_y", "counted_n",
        ((F.col("yea_total") + F.col("nay_total")) < 100).alias("small"),
        ((F.col("yea_total") != F.col("counted_y")) | (F.col("nay_total") != F.col("counted_n"))).alias("differs"),
    )
