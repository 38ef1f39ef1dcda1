"""Sinks: partitioned JSON and CSV, run manifests, and skipping of finished work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from daytrace.functions import text as tx

PARTITIONS = ("user", "modality", "model")


def without_nulls(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows as one JSON text with null fields left out."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("value"))


def write_metadata(records: DataFrame, path: str, by: Sequence[str] = ("user",), mode: str = "errorifexists") -> None:
    """Clean session records, one object per line, duration as ``0.00s``, null fields left out."""
    records.withColumn("duration", tx.format_seconds("duration")).write.mode(mode).partitionBy(*by).json(path)


def write_layer(rows: DataFrame, path: str, by: Sequence[str] = PARTITIONS, append: bool = False) -> None:
    """JSON lines below user/modality/model folders.  Observation layers overwrite, statements append."""
    rows.write.mode("append" if append else "overwrite").partitionBy(*[b for b in by if b in rows.columns]).json(path)


def write_csv(rows: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    out = rows.write.mode(mode).option("header", True).option("escape", '"')
    (out.partitionBy(*by) if by else out).csv(path)


def write_manifest(df_spark, path: str, **params) -> None:
    """One-row JSON manifest of a run; fails when the run already has one."""
    values = {k: ("+".join(v) if isinstance(v, (list, tuple)) else v) for k, v in params.items()}
    df_spark.createDataFrame([values]).coalesce(1).write.mode("errorifexists").json(path)


def pending(planned: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned keys that have no finished output yet."""
    return planned.join(finished.select(*keys), list(keys), "left_anti")


def distance_matrix(distances: DataFrame) -> DataFrame:
    """Long distances (a, b, distance) → one column per ``b``, blank diagonal."""
    shown = distances.withColumn("distance", F.when(F.col("a") != F.col("b"), F.col("distance")))
    return shown.groupBy("a").pivot("b").agg(F.first("distance")).orderBy("a")


def write_calibration(bounds: DataFrame, curve: DataFrame, path: str) -> None:
    bounds.write.mode("overwrite").json(f"{path}/bounds")
    curve.write.mode("overwrite").json(f"{path}/curve")
