"""Pages of a list: which page a request means, which page numbers are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pages shown at either end, pages from an end that count as near it, pages shown beyond a gap, and beside the page.
SHOWN_AT_END, NEAR_END, BEYOND, BESIDE = 8, 6, 2, 2


def asked_page(raw: Column, pages: Column) -> Column:
    """The page a request means: the first where it is no number, the last where it is beyond it (or below the first)."""
    n = raw.try_cast("int")
    last = F.greatest(pages, F.lit(1))
    return F.when(n.isNull(), 1).when((n < 1) | (n > last), last).otherwise(n)


def page_numbers(page: Column, pages: Column) -> Column:
    """struct<before, shown, after> of page numbers: all where there are few, else those at an end or beside the page; the first two are
    `before` a gap, the last two `after` one, falling. One page shows none."""
    none = F.array().cast("array<int>")
    seq = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    one = F.lit(1)
    few, lead, trail = pages <= SHOWN_AT_END + BEYOND + 1, page <= NEAR_END, page > pages - NEAR_END
    tail = F.sequence(pages, pages - (BEYOND - 1), F.lit(-1))
    shown = F.when(few, seq(one, pages)).when(lead, seq(one, F.lit(SHOWN_AT_END))).when(trail, seq(F.greatest(one, pages - SHOWN_AT_END + 1), pages)).otherwise(
        seq(F.greatest(one, page - BESIDE), F.least(pages, page + BESIDE))
    )
    before = F.when(few | lead, none).otherwise(F.sequence(one, F.lit(BEYOND)))
    after = F.when(few | trail & ~lead, none).otherwise(tail)
    empty = pages <= 1
    return F.struct(*[F.when(empty, none).otherwise(x).alias(n) for x, n in ((before, "before"), (shown, "shown"), (after, "after"))])


def page_rows(df: DataFrame, raw: str | None, per_page: int, *order: Column) -> DataFrame:
    """The rows of the page asked for, in order. The number of rows is one row joined to each, so nothing is counted beforehand;
    the page is cut by the rank, which Spark limits in every task where the page is known."""
    pages = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / per_page)).cast("int").alias("_pages"))
    page = asked_page(F.lit(raw), F.col("_pages"))
    from pyspark.sql import Window

    if raw is None or not raw.strip().lstrip("+-").isdigit():  # the first page
        return df.orderBy(*order).limit(per_page)
    ranked = df.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    got = ranked.crossJoin(F.broadcast(pages)).filter((F.col("_rn") > (page - 1) * per_page) & (F.col("_rn") <= page * per_page))  # one row
    return got.orderBy("_rn").drop("_rn", "_pages")
