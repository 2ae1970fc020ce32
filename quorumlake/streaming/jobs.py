"""Streaming jobs: change queue, alerts, idempotent events, windows (G1-G12). Every job is a plain function of a streaming
DataFrame and runs with any trigger; `run_once` drains what is there, as the batch queries and tests do."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.session import shared_dir


def file_stream(spark: SparkSession, folder: str, name: str, **options: str) -> DataFrame:
    """The files of a table as a stream; its schema is read from the table, never inferred from data."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def run_once(stream: DataFrame, batch: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Drains the source through `batch` (foreachBatch), with a checkpoint in the shared folder."""
    at = checkpoint or f"{shared_dir(stream.sparkSession)}/streams/{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows a streaming query gives, as a table: each batch writes its own folder, so a repeated batch replaces itself."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/streams/out-{uuid.uuid4().hex}"
    if mode == "complete":
        run_once(stream, lambda df, i: df.write.mode("overwrite").parquet(out), mode)
        return spark.read.schema(stream.schema).parquet(out)
    run_once(stream, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), mode)
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def apply_changes(state: DataFrame, changes: DataFrame, key: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """`state` after a batch of changes (key, action update/delete, order, and the state's columns): all updates, the latest
    of a key by `order`, then all deletes, whatever their order (G2). Updates of keys not in `existing` are dropped."""
    cols = [c for c in state.columns if c != key]
    ups = changes.filter("action = 'update'")
    if existing is not None:
        ups = ups.join(existing.select(key), key, "left_semi")
    latest = ups.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_s")).select(key, *[F.col(f"_s.{c}").alias(c) for c in cols])
    gone = changes.filter("action = 'delete'").select(key)
    return state.join(latest, key, "left_anti").unionByName(latest).join(gone, key, "left_anti")


class QueueConsumer:
    """Keeps an index table up to date from a stream of changes. Rows lie in buckets of their key, and a batch writes new
    versions of the buckets it touches, as folders batch=N/bucket=K. What counts of a bucket is its newest version from before
    the batch, found on disk, so a batch that is run again gives the same and a restarted consumer of the same folder goes on
    where it stood. Buckets are a fixed number; only their numbers reach the driver."""

    def __init__(self, state: DataFrame, key: str, order: str, root: str | None = None, buckets: int = 32) -> None:
        self.spark, self.key, self.order, self.buckets = state.sparkSession, key, order, buckets
        self.root = root or f"{shared_dir(self.spark)}/streams/index-{uuid.uuid4().hex}"
        self.schema = state.schema
        if not self._versions():
            self._write(state.withColumn("bucket", self._bucket()), -1)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, batch: int) -> None:
        # Every touched bucket gets a folder, an emptied one too: a row without a key keeps it.
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/batch={batch}")

    def _versions(self, before: int | None = None) -> dict[int, str]:
        """bucket -> folder of its newest whole version."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(conf)
        newest: dict[int, tuple[int, str]] = {}
        for v in fs.listStatus(at) if fs.exists(at) else []:
            n = int(v.getPath().getName().split("=")[1])
            if (before is not None and n >= before) or not fs.exists(jvm.org.apache.hadoop.fs.Path(v.getPath(), "_SUCCESS")):
                continue
            for b in fs.listStatus(v.getPath()):
                name = b.getPath().getName()
                if name.startswith("bucket=") and newest.get(int(name[7:]), (-2, ""))[0] < n:
                    newest[int(name[7:])] = (n, b.getPath().toString())
        return {k: p for k, (_, p) in newest.items()}

    def table(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        paths = [p for k, p in self._versions(before).items() if only is None or k in only]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return rows.filter(F.col(self.key).isNotNull())

    def __call__(self, changes: DataFrame, batch: int) -> None:
        touched = sorted(r.bucket for r in changes.select(self._bucket().alias("bucket")).distinct().collect())
        if not touched:
            return
        new = apply_changes(self.table(batch, touched), changes, self.key, self.order).select(*self.schema.names).withColumn("bucket", self._bucket())
        marks = self.spark.createDataFrame([(k,) for k in touched], "bucket int")
        empty = marks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], "bucket")
        self._write(new.unionByName(empty).repartition("bucket"), batch)


def alerts(items: DataFrame, topics: DataFrame, match: Column, item: str, at: str, watermark: str | None = "60 days", post: Column | None = None, bound: int = 50_000) -> DataFrame:
    """topic and item columns, each (topic, item) once: a stream of items joined with the static topics; seen pairs are the
    stream's state, kept for `watermark` of event time (None: forever). `post` drops items after they count as seen (G4).
    Any condition may match, so the topics go to every task: their number is checked against `bound` first. Topics that are
    matched by equality have no bound in `new_items`."""
    if topics.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} topics: match them by an equality with new_items")
    hits = items.join(F.broadcast(topics), match)  # bounded above
    if watermark and items.isStreaming:
        once = hits.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["topic", item])
    else:
        once = hits.dropDuplicates(["topic", item])
    return once.filter(post) if post is not None else once


def new_items(hits: DataFrame, seen: DataFrame, limit: int = 25, horizon: Column | None = None) -> DataFrame:
    """The hits (topic, item, at …) of one run that are new to their topic (G3): of each topic the newest `limit` count, of
    equal times the greater item first, and of them those not in `seen` (topic, item). Older ones beyond the limit are never
    sent. `horizon` leaves out what is older (D6). Rows equal in topic and item count once."""
    from pyspark.sql import Window

    one = hits.dropDuplicates(["topic", "item"])
    one = one.filter(F.col("at") >= horizon) if horizon is not None else one
    newest = one.withColumn("_rn", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("at"), F.desc("item")))).filter(F.col("_rn") <= limit)
    return newest.join(seen.select("topic", "item"), ["topic", "item"], "left_anti").select(*hits.columns)


def initialised(topics: DataFrame, as_of: Column) -> DataFrame:
    """Topics that must be initialised: never checked, or not for a day (G5). Their newest forty hits are marked as seen and
    not sent."""
    return topics.filter(F.col("last_checked").isNull() | (F.col("last_checked") < as_of - F.expr("interval 24 hours")))


def without_chair(items: DataFrame, of_member: Column, who: str = "who", text: str = "text", least: int = 1200) -> DataFrame:
    """Items without the chair's short ones, for topics that follow a member (G4); they are seen all the same."""
    return items.filter(~of_member | ~F.coalesce(F.col(who).contains("Speaker"), F.lit(False)) | (F.length(text) > least))


class AlertRun:
    """A consumer of batches of hits: what is new of each batch goes to `send`, and all of it is seen from then on. Seen pairs
    are folders of their batch, without expiry; a batch that is run again reads those before it."""

    def __init__(self, spark: SparkSession, send, limit: int = 25, root: str | None = None, types: str = "topic string, item long") -> None:
        self.spark, self.send, self.limit, self.types = spark, send, limit, types
        self.root = root or f"{shared_dir(spark)}/streams/seen-{uuid.uuid4().hex}"
        spark.createDataFrame([], types).withColumn("batch", F.lit(-1)).write.mode("overwrite").partitionBy("batch").parquet(self.root)

    def seen(self, before: int) -> DataFrame:
        return self.spark.read.schema(f"{self.types}, batch int").parquet(self.root).filter(F.col("batch") < before)

    def __call__(self, hits: DataFrame, batch: int) -> None:
        new = new_items(hits, self.seen(batch), self.limit)
        self.send(new, batch)
        new.select("topic", "item").write.mode("overwrite").parquet(f"{self.root}/batch={batch}")


def former_members(alerts_: DataFrame, held: DataFrame) -> DataFrame:
    """alert_id, politician_id, riding_id, new_politician_id of active alerts for people who are no longer in office (G14): the
    riding of their latest membership and who holds it now. `held`: politician_id, riding_id, start_date, end_date."""
    now = held.filter("end_date is null")
    last = held.groupBy("politician_id").agg(F.max(F.struct("start_date", "riding_id"))["riding_id"].alias("riding_id"))
    bad = alerts_.filter("active").join(now.select("politician_id"), "politician_id", "left_anti").join(last, "politician_id")
    return bad.join(now.select("riding_id", F.col("politician_id").alias("new_politician_id")), "riding_id").select("alert_id", "politician_id", "riding_id", "new_politician_id")


class RateLimit:
    """At most `calls` calls in any `per` seconds (G13): `wait` gives the seconds to sleep before the next. For calls of a driver
    to another system; a cluster's tasks have no common clock of this kind."""

    def __init__(self, calls: int, per: float) -> None:
        self.calls, self.per = calls, per
        self.times: deque[float] = deque()

    def wait(self, now: float) -> float:
        while self.times and now - self.times[0] > self.per:
            self.times.popleft()
        pause = max(0.0, self.per - (now - self.times[0])) if len(self.times) >= self.calls else 0.0
        self.times.append(now + pause)
        return pause


def fan_out(sent: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One message per active subscriber whose address doesn't bounce."""
    return sent.join(subscriptions.filter("active and not bouncing").select("topic", "user"), "topic")


def once_by_id(events: DataFrame, guid: str) -> DataFrame:
    """Events once by their id."""
    return events.dropDuplicates([guid])


def window_counts(events: DataFrame, at: str, keys: list[str], size: str, late: str) -> DataFrame:
    """Counts and sums per event-time window; rows later than `late` are dropped in append mode."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), *keys, "n")
    )
