import datetime as dt

import pytest
from pyspark.sql import functions as F

from quorumlake import session
from quorumlake.operators import corpora, paging, resources, search, writes
from quorumlake.operators.filters import BadRequest
from quorumlake.streaming import jobs


def test_queue_consumer_goes_on_after_a_restart(spark, tmp_path):
    cols = "k long, action string, doc string, v int"
    state = spark.createDataFrame([(i, f"d{i}", 0) for i in range(20)], "k long, doc string, v int")
    one = jobs.QueueConsumer(state, "k", "v", root=str(tmp_path / "ix"), buckets=4)
    one(spark.createDataFrame([(1, "update", "new", 1), (2, "delete", "", 2), (50, "update", "more", 3)], cols), 0)
    again = jobs.QueueConsumer(state, "k", "v", root=str(tmp_path / "ix"), buckets=4)  # a new process, the same folder
    again(spark.createDataFrame([(1, "update", "newer", 4), (3, "delete", "", 5)], cols), 1)
    again(spark.createDataFrame([(1, "update", "newer", 4), (3, "delete", "", 5)], cols), 1)  # run again
    again(spark.createDataFrame([], cols), 2)
    got = {r.k: r.doc for r in again.table().collect()}
    assert got == {i: f"d{i}" for i in range(20) if i not in (2, 3)} | {1: "newer", 50: "more"}


def test_alert_runs(spark, tmp_path):
    at = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(hours=i)
    hits = lambda n: spark.createDataFrame([("a", i, at(i)) for i in range(n)], "topic string, item long, at timestamp_ntz")
    sent = []
    run = jobs.AlertRun(spark, lambda df, i: sent.append(sorted(r.item for r in df.collect())), limit=5, root=str(tmp_path / "seen"))
    run(hits(10), 0)
    run(hits(12), 1)
    run(hits(12), 1)  # run again: the same
    run(hits(12), 2)
    assert sent == [[5, 6, 7, 8, 9], [10, 11], [10, 11], []]
    assert jobs.new_items(hits(3), spark.createDataFrame([], "topic string, item long"), horizon=F.lit(at(2))).count() == 1
    with pytest.raises(ValueError):
        jobs.alerts(hits(3), spark.createDataFrame([("a",), ("b",)], "t string"), F.lit(True), "item", "at", bound=1)


def test_rate_limit():
    r = jobs.RateLimit(2, 10)
    assert [r.wait(t) for t in (0, 1, 2, 13, 30)] == [0, 0, 8, 0, 0]


def test_pages(spark):
    df = spark.range(47).select("id")
    ids = lambda raw: [r.id for r in paging.page_rows(df, raw, 10, F.col("id")).collect()]
    assert ids(None) == ids("x") == list(range(10)) and ids("3") == list(range(20, 30)) and ids("99") == ids("0") == list(range(40, 47))
    assert paging.page_rows(df.limit(0), "2", 10, F.col("id")).count() == 0


def test_writes(spark, tmp_path):
    state = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    got = writes.insert_missing(state, spark.createDataFrame([(1, "z"), (2, "c"), (2, "b"), (None, "m")], "k long, v string"), ["k"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", False), (2, "b", True), (None, "n", False)]
    p = str(tmp_path / "t")
    writes.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "d int, v string"), p, "d")
    writes.replace_partitions(spark.createDataFrame([(2, "c")], "d int, v string"), p, "d")
    assert sorted((r.d, r.v) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "c")]
    assert writes.delete_keys(state, state.limit(0), ["k"]).count() == 2


def test_addresses_are_checked(spark):
    docs = spark.createDataFrame([(1, "D", dt.date(2020, 1, 2))], "id long, document_type string, date date")
    meet = spark.createDataFrame([("health", "41-1", 3, 7)], "committee string, session string, number int, evidence_id long")
    by = resources.ByDocument(docs, meet)
    st = spark.createDataFrame([(10, 1), (11, 7)], "id long, document_id long")
    assert [r.id for r in by.apply(st, "exact", "/debates/2020/1/2/").collect()] == [10] and [r.id for r in by.apply(st, "exact", "/committees/health/41-1/3/").collect()] == [11]
    for bad in ("/debates/2020/13/2/", "/x/2020/1/2/", "/debates/", "/committees/health/41-1/x/"):
        with pytest.raises(BadRequest):
            by.apply(st, "exact", bad)


def test_search_by_stems_and_orders(spark):
    index = spark.createDataFrame([("petition", 1, 1), ("petitions", 1, 2), ("the", 1, 5), ("petitioned", 2, 1)], "term string, doc_id long, tf long")
    assert {(r.term, r.doc_id, r.tf) for r in search.stemmed(index).collect()} == {("petit", 1, 3), ("petit", 2, 1)}
    hits = spark.createDataFrame([(1, 2.0, None), (2, 1.0, dt.date(2020, 1, 1)), (3, 3.0, dt.date(2021, 1, 1))], "doc_id long, score double, date date")
    order = lambda s: [r.doc_id for r in hits.orderBy(*search.ordered(hits, s, "doc_id")).collect()]
    assert order("date asc") == [2, 3, 1] and order("date desc") == [3, 2, 1] and order("; drop") == [3, 1, 2]


def test_analyses():
    assert corpora.safe_name("Health & Water-2") == "healthwater-2" and [a.expires_days for a in corpora.ANALYSES][1:] == [7, 14]


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Far:
        master = "spark://far:7077"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Far

    with pytest.raises(RuntimeError):
        session.shared_dir(Session)
    session.written(spark.range(3), "t")
    assert session.release(spark) >= 1 and session.release(spark) == 0
