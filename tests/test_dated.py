"""p4 and p6 on small tables that pin the unclear cases, and the dyadic nodes by brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quorumlake.operators.asof import LEVELS, as_known, dyadic_nodes, latest_known
from quorumlake.operators.history import versions

D = dt.date
T = dt.datetime
LOG = "id long, politician_id long, party_id long, start_date date, recorded_at timestamp_ntz, extra string"
KW = {"entity": "politician_id", "start": "start_date", "recorded": "recorded_at", "tie": "id"}


def test_nodes_tile_exactly(spark):
    random.seed(3)
    cases = [(a, b) for a in range(0, 20) for b in range(a, 20)]
    for _ in range(40):
        a = random.randrange(1 << LEVELS)
        cases.append((a, random.randrange(a, (1 << LEVELS) + 1)))
    cases.append((0, 1 << LEVELS))
    df = spark.createDataFrame(cases, "lo int, hi int").withColumn("n", dyadic_nodes(F.col("lo"), F.col("hi")))
    for lo, hi, n in df.collect():
        spans = sorted((x.node << x.level, (x.node + 1) << x.level) for x in n)
        at = lo
        for s, e in spans:
            assert s == at, (lo, hi, spans)
            at = e
        assert at == hi or lo == hi and not spans
        assert len(n) <= 2 * LEVELS + 1


def _known(spark, log, events):
    lg = spark.createDataFrame(log, LOG)
    ev = spark.createDataFrame(events, "eid long, politician_id long, date date, party_id long")
    out = as_known(ev, lg, at="date", attributes=["party_id"], **KW)
    return {r.eid: r.known_party_id for r in out.collect()}


def test_known_at_event_time(spark):
    log = [
        (1, 1, 10, D(2015, 1, 1), T(2015, 1, 1, 23, 59), "x"),  # known on the very day
        (2, 1, 11, D(2016, 1, 1), T(2016, 6, 1), "x"),  # late entry
        (3, 1, 12, D(2016, 1, 1), T(2017, 1, 1), "x"),  # correction of equal start
        (4, 1, 13, D(2018, 1, 1), T(2017, 5, 1), "x"),  # entered ahead
        (4, 1, 13, D(2018, 1, 1), T(2017, 5, 1), "x"),  # redelivered
        (5, 1, 14, None, T(2010, 1, 1), "x"),
        (6, 1, 15, D(2019, 1, 1), None, "x"),
        (7, None, 16, D(2010, 1, 1), T(2010, 1, 1), "x"),
        (8, 2, None, D(2015, 1, 1), T(2015, 1, 1), "x"),  # a null party is what was known
    ]
    days = [D(2014, 12, 31), D(2015, 1, 1), D(2016, 5, 31), D(2016, 6, 1), D(2016, 12, 31), D(2017, 1, 1), D(2017, 12, 31),
            D(2018, 1, 1), None]
    events = [(i, 1, d, 99) for i, d in enumerate(days)] + [(100, None, D(2020, 1, 1), 1), (101, 3, D(2020, 1, 1), 1)]
    got = _known(spark, log, events + [(102, 2, D(2016, 1, 1), 1), (103, 1, D(2018, 1, 1), None)])
    assert [got[i] for i in range(9)] == [None, 10, 10, 11, 11, 12, 12, 13, None]
    assert got[100] is None and got[101] is None and got[102] is None and got[103] == 13 and len(got) == 13


def test_known_empty(spark):
    assert _known(spark, [], [(1, 1, D(2015, 1, 1), 5)]) == {1: None}
    assert _known(spark, [(1, 1, 1, D(2015, 1, 1), T(2015, 1, 1), "")], []) == {}


def test_known_random_against_brute_force(spark):
    random.seed(5)
    base = D(2015, 1, 1)
    day = lambda n: base + dt.timedelta(n)
    log = [
        (i, random.randrange(4), random.randrange(9), day(random.randrange(60)), T(2015, 1, 1) + dt.timedelta(random.randrange(80)), "")
        for i in range(60)
    ]
    events = [(i, random.randrange(5), day(random.randrange(-5, 100)), 0) for i in range(300)]
    got = _known(spark, log, events)
    for eid, p, d, _ in events:
        ok = [r for r in log if r[1] == p and r[3] <= d and r[4].date() <= d]
        assert got[eid] == (max(ok, key=lambda r: (r[3], r[4], r[0]))[2] if ok else None)
    latest = {r.politician_id: r.party_id for r in latest_known(spark.createDataFrame(log, LOG), attribute="party_id", **KW).collect()}
    for p in latest:
        assert latest[p] == max((r for r in log if r[1] == p), key=lambda r: (r[3], r[4], r[0]))[2]


SNAP = "taken_on date, loaded_at timestamp_ntz, politician_id long, party_id long, note string"


def _versions(spark, rows):
    df = spark.createDataFrame(rows, SNAP)
    out = versions(df, entity="politician_id", taken="taken_on", loaded="loaded_at", attributes=["party_id"])
    return sorted((r.politician_id, str(r.valid_from), str(r.valid_to), r.party_id) for r in out.collect())


def test_versions(spark):
    m = [D(2016, k, 1) for k in range(1, 7)]
    t = lambda d, h=1: T(d.year, d.month, d.day, h)
    rows = [(d, t(d), 9, 1, "z") for d in m if d != m[3]]  # absent at m[3]: two versions
    rows += [(m[0], t(m[0]), 1, 5, "a"), (m[0], t(m[0], 9), 1, 6, "a"), (m[1], t(m[1]), 1, 6, "b"), (m[1], t(m[1]), 1, 6, "b")]
    rows += [(m[2], t(m[2]), 1, None, ""), (m[3], t(m[3]), 1, None, ""), (None, t(m[3]), 1, 7, ""), (m[3], t(m[3]), None, 7, "")]
    rows += [(m[4], t(m[4]), 2, 1, ""), (m[4], t(m[4]), 2, None, "")]  # a tie: the value wins over null
    assert _versions(spark, rows) == [
        (1, "2016-01-01", "2016-03-01", 6),
        (1, "2016-03-01", "2016-05-01", None),
        (2, "2016-05-01", "2016-06-01", 1),
        (9, "2016-01-01", "2016-04-01", 1),
        (9, "2016-05-01", "None", 1),
    ]
    assert _versions(spark, []) == []
