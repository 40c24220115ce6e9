"""Session settings and the shared working folder."""
from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "landloom", **conf) -> SparkSession:
    """A session with the settings the operators count on; cluster sizing stays with spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Column call sites cost a JVM round trip each and only serve error texts.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """These settings for the jobs that are run inside; what was set before holds again afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. The cluster names it in ``spark.checkpoint.dir``;
    only where that is unset (tests, local runs) is a temporary folder made."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="landloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def run_dir(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared folder for one run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Write to a table of its own in the shared folder and read it back. Survives lost executors,
    and unlike an RDD checkpoint the readers prune columns and know its size when they plan joins."""
    spark = df.sparkSession
    path = run_dir(spark, "cut")
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df, *keys):
    """Hash-partition by ``keys`` into the configured number of shuffle partitions, exempt from
    run-time coalescing. For steps whose work per byte is large: the grouping that follows reuses the
    partitioning, so no shuffle is added, and small inputs still use every core."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
