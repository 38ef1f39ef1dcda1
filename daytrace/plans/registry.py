"""Registry of named queries over the star-schema tables, with DuckDB SQL for the same result where SQL can
say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded double under a name; -0.0 becomes 0.0 so that both engines print the same."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col.cast("double"), digits) + F.lit(0.0)).alias(name)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that arrives in fewer splits than there are cores before heavy per-row work; tables with
    enough splits pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
