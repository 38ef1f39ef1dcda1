"""Spark session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def build_session(app: str = "daytrace", cpus: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session instead."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", os.environ.get("DAYTRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only in local mode."""
    key = "spark.checkpoint.dir"
    configured = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    made = getattr(spark, "_daytrace_scratch", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="spark-daytrace-", dir="/tmp")
        spark._daytrace_scratch = made
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder of its own below the scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/daytrace/{name}-{uuid.uuid4().hex}"


def long_rows(spark: SparkSession, rows: int = 500) -> None:
    """From now on the session's Arrow batches hold at most ``rows`` rows. For tables of long texts: a Python worker holds a batch
    several times over, so its memory follows the batch and not the partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, now) if now > 0 else rows))


@contextmanager
def no_broadcasts(spark: SparkSession):
    """Joins of the jobs run inside are shuffled: a table that is broadcast goes through the driver, which in rounds adds up. The
    caller's settings are put back."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back, so that later rounds neither
    recompute it nor depend on any executor that may be lost."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/daytrace/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` plus the number of rows, observed during the write."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]
