"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a fresh session gets. A cluster's own values win: they are only applied by `local_session`.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def local_session(cpus: str | int = "*", app: str = "quorumlake", **more: str) -> SparkSession:
    """A local session with the engine's defaults; `more` has extra settings with `__` for the dots."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a local session (tests) gets a temporary
    one; on a cluster a folder of one machine would lose rows, so it is an error there."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quorumlake-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Folders that `written` made, by session.
_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: cuts lineage, survives lost executors. The tables of a
    session are removed by `release` when their results have been read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the intermediate tables of the session and gives their number. Results that read them must be stored before."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)
