"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def fold_of(name: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id, which is in no fold."""
    return F.crc32(F.col(f"`{name}`").cast("string")) % folds


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` (names compared without case) has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def bounded_labels(labels: DataFrame, label: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most about ``bound`` labelled ids, half of them from each class where a class has that many: columns id, y.

    A row is taken by a hash of its id, so the choice does not depend on partitions. Null ids and null labels take no part;
    an id labelled twice keeps its larger label.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where("y in (0, 1)").collect()}
    keep = F.lit(False)
    for y, n in sizes.items():
        share = min(1.0, bound / 2 / n)
        keep = keep | ((F.col("y") == y) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    return rows.where(keep)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows for the jobs run inside: texts are long, and a batch is held several times over.
    The caller's setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def long_rows(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session's Arrow batches hold at most ``rows`` rows: documents are long, and the JVM keeps a batch
    outside its heap several times over. For jobs that own their session; ``small_batches`` puts the setting back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, now) if now > 0 else rows))


def one_by_one(texts: pa.Array) -> Iterator[str | None]:
    """The texts of a batch, one Python string at a time; memory that Arrow no longer needs goes back first."""
    pa.default_memory_pool().release_unused()
    return (t.as_py() for t in texts)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int, share: int = 10_000) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique and whose column ``rows`` says how many rows of ``left`` have the key.

    Keys with more than ``total / share`` rows (fewer than ``share`` of them, whatever the data) meet by broadcast, so no task gets
    a hot key; the others meet by an ordinary join. Keys are not null.
    """
    is_hot = F.col(rows) > total // share
    hot, cold = F.broadcast(right.where(is_hot)), right.where(~is_hot)
    keys = F.broadcast(right.where(is_hot).select(*on))
    return left.join(hot, on).unionByName(left.join(keys, on, "left_anti").join(cold, on))


def arrow_matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` items, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def whole_vector(vec: Column) -> Column:
    """Neither null nor empty, and every component a finite number."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & finite, F.lit(False))


def floored(vec: Column, scale: int, bound: int) -> Column:
    """floor(scale * component) of each component as a long, held within ``bound`` on both sides."""
    held = lambda x: F.greatest(F.least(x * scale, F.lit(float(bound))), F.lit(float(-bound)))
    return F.transform(vec, lambda x: F.floor(held(x)).cast("long"))


def usual_length(rows: DataFrame, vec: str) -> tuple[int, int]:
    """The length that most vectors have (the smaller on a tie) and how many have it; zeros for an empty table."""
    sizes = rows.groupBy(F.size(vec).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return (sizes[0]["d"], sizes[0]["n"]) if sizes else (0, 0)
