"""Date and time functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(day: Column, hour: Column, minute: Column) -> Column:
    """Wall time of a sitting day; hours from 24 on belong to the days after."""
    secs = (hour * 3600 + minute * 60).cast("double")
    return F.to_timestamp_ntz(F.date_format(day, "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def hour24(hour: Column, half: Column) -> Column:
    """Hours of the 12-hour clock; any half with a p in it is the second, twelve is noon or midnight (D3)."""
    h = hour + F.when(F.lower(half).contains("p") | (F.lower(half) == "noon"), 12).otherwise(0)
    return F.when(h % 12 == 0, h - 12).otherwise(h)


def house_met(text: Column, day: Column) -> Column:
    """When a sitting began, from 'The House met at 2:30 p.m.' or the French words; without a half it is the 24-hour clock."""
    pat = r"(?i)^\s*(?:The\s+House\s+met\s+at|La\s+séance\s+est\s+ouverte\s+à)\s+(\d+)(?:[:.](\d+))?[:.]*\s*([ap]\.m\.)?"
    h, m, half = (F.regexp_extract(text, pat, k) for k in (1, 2, 3))
    hour = h.try_cast("int")
    hour = F.when(half == "", hour).when(F.lower(half).startswith("p"), hour % 12 + 12).otherwise(hour % 12)
    return F.when(text.rlike(pat), clock(day, hour, F.coalesce(m.try_cast("int"), F.lit(0))))


def named_day(text: Column) -> Column:
    """'March 11, 2011' as a date, null for anything else."""
    return F.try_to_timestamp(text, F.lit("MMMM d, yyyy")).cast("date")


def leading_day(text: Column) -> Column:
    """The date in front of a longer stamp."""
    return F.left(text, F.lit(10)).try_cast("date")


def meets_at(day: Column, hour: Column, minute: Column) -> Column:
    """Day and time of day put together; null where the time is unknown."""
    return F.when(hour.isNotNull(), clock(day, hour, F.coalesce(minute, F.lit(0))))


def is_future(at: Column, as_of: Column) -> Column:
    return F.coalesce(at > as_of, F.lit(False))


#: Days after which a document is fetched again.
INTERVALS = (1, 2, 3, 7, 14, 21, 30, 50, 100, 150, 200, 300, 400, 550, 700, 1000)


def is_due(first: Column, day: Column, as_of: Column) -> Column:
    """Whether a document is due again: by the day it was first imported, by its own where that is unknown."""
    return F.coalesce(F.datediff(as_of, F.coalesce(first, day)).isin(*INTERVALS), F.lit(False))


# Days from which on a past date is called so.
SINCE = ((1, "Yesterday"), (2, "Two days ago"), (3, "Three days ago"), (4, "This week"), (7, "A week ago"), (14, "Two weeks ago"), (21, "Three weeks ago"),
         (28, "A month ago"), (45, "Two months ago"), (75, "Three months ago"), (105, "More than three months ago"))


def time_since(day: Column, as_of: Column) -> Column:
    """How long ago a day was, in words; today and later is 'Today' (F16)."""
    n = F.datediff(as_of, day)
    out = None
    for least, words in reversed(SINCE):
        out = F.when(n >= least, words) if out is None else out.when(n >= least, words)
    return out.when(n < 1, "Today")


def month_range(text: Column) -> Column:
    """struct<lo, hi> of 'Y-M[-D][ to Y-M[-D]]': whole months where the day is missing; hi is exclusive but for the minute
    and second that the search adds: it is the last day's midnight plus 61 seconds."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^(\d{4})-(\d{1,2})(?:-(\d{1,2}))?(?: to (\d{4})-(\d{1,2})(?:-(\d{1,2}))?)?", k), F.lit("")).cast("int")
    lo = F.make_date(part(1), part(2), F.coalesce(part(3), F.lit(1)))
    y, m = F.coalesce(part(4), part(1)), F.coalesce(part(5), part(2))
    given = F.when(part(4).isNotNull(), part(6)).otherwise(part(3))
    last = F.when(given.isNull(), F.last_day(F.make_date(y, m, F.lit(1)))).otherwise(F.make_date(y, m, given))
    return F.struct(lo.cast("timestamp_ntz").alias("lo"), (F.date_add(last, 1).cast("timestamp_ntz") + F.expr("interval 61 seconds")).alias("hi"))


def horizon(as_of: Column) -> Column:
    """First day of the month sixty days before."""
    return F.trunc(F.date_sub(as_of, 60), "MM")


def is_stale(at: Column, as_of: Column, days: int) -> Column:
    return F.coalesce(F.datediff(as_of, at) > days, F.lit(False))
