"""Greedy one-to-one matching of two sets of vectors without listing all their similar pairs.

A greedy pass takes pairs by falling cosine, so it can run in bands: the pairs above a floor are listed and settled, rows without
copies left drop out, and the next band lists pairs of the remaining rows only. Pairs are counted by cosine before each band and the
floor of a key is put where the band holds about ``per_row`` pairs a row, so what is listed follows the rows and not the pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from daytrace.functions.common import join_on
from daytrace.operators.graph import greedy_matching
from daytrace.operators.similarity import BLOCK_ROWS, STRIP, _apply, _ddl, _matrix, _repeat_key, block_pairs
from daytrace.session import cut

PER_ROW, LEAST = 16, 65_536  # pairs of a band: per row of the key, and at least
BITS = (12, 26)  # cells of 2^-12; where one of them holds more than a band, cells of 2^-26 inside it


def _cells(left: DataFrame, right: DataFrame, bases: DataFrame, keys: list[str], bits: int, block_rows: int) -> DataFrame:
    """Pairs of a key with a cosine of at least its ``base``, counted by cells of 2^-bits above it: keys, cell, n."""
    own = join_on(left, bases.select(*keys, "base"), keys).select(*keys, "id", "vec", "base")
    lefts, rights = block_pairs(own, right.select(*keys, "id", "vec"), keys, "id", block_rows, few=True)
    scale, most = 2.0**bits, 1 << 14

    def fn(l: pa.Table, r: pa.Table) -> pa.Table:
        counts = np.zeros(most, np.int64)
        if l.num_rows and r.num_rows:
            a, b, base = _matrix(l, "vec"), _matrix(r, "vec").T, l.column("base")[0].as_py()
            for at in range(0, len(a), STRIP):
                cos = a[at:at + STRIP] @ b
                cell = np.minimum((cos[cos >= base] - base) * scale, most - 1).astype(np.int64)
                counts += np.bincount(cell, minlength=most)
        cell = np.flatnonzero(counts)
        head = _repeat_key(l if l.num_rows else r, keys, len(cell))
        return pa.table({**head, "cell": pa.array(cell, pa.int64()), "n": pa.array(counts[cell], pa.int64())})

    schema = ", ".join([_ddl(left, keys)] * bool(keys) + ["cell bigint, n bigint"])
    return _apply(lefts, rights, keys, fn, schema).groupBy(*keys, "cell").agg(F.sum("n").alias("n"))


def _floors(left: DataFrame, right: DataFrame, bases: DataFrame, keys: list[str], per_row: int, least: int, block_rows: int) -> DataFrame:
    """Where the next band of each key with pairs ends: keys, floor, ``last`` (no pairs lie below)."""
    sizes = left.select(*keys).unionByName(right.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    room = join_on(bases, sizes.select(*keys, F.greatest(F.col("rows") * per_row, F.lit(least)).alias("room")), keys)

    def placed(bits: int, rooms: DataFrame) -> DataFrame:
        counted = join_on(_cells(left, right, rooms, keys, bits, block_rows), rooms, keys)
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0))
        ends = counted.withColumn("_upto", upto).groupBy(*keys, "base", "room").agg(
            F.min(F.when(F.col("_upto") <= F.col("room"), F.col("cell"))).alias("_fits"), F.max("cell").alias("_top"), F.max("_upto").alias("_all"))
        floor = F.col("base") + F.coalesce("_fits", "_top") / F.lit(2.0**bits)
        last = F.col("_all") <= F.col("room")
        return cut(ends.select(*keys, "base", "room", F.when(last, F.col("base")).otherwise(floor).alias("floor"), last.alias("last"), F.col("_fits").isNull().alias("dense")))

    first = placed(BITS[0], room)
    dense = first.where("dense")
    if dense.isEmpty():
        return first.select(*keys, "floor", "last")
    finer = placed(BITS[1], dense.select(*keys, F.col("floor").alias("base"), "room"))
    return first.where("not dense").select(*keys, "floor", "last").unionByName(finer.select(*keys, "floor", F.lit(False).alias("last")))


def _pairs_from(left: DataFrame, right: DataFrame, floors: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Pairs (i, j, cos) of each key from its floor up."""
    own = join_on(left, floors.select(*keys, "floor"), keys).select(*keys, "id", "vec", "floor")
    lefts, rights = block_pairs(own, right.select(*keys, "id", "vec"), keys, "id", block_rows, few=True)
    schema = f"{', '.join([_ddl(left, keys)] * bool(keys) + [_ddl(left, ['id'], {'id': 'i'}), _ddl(right, ['id'], {'id': 'j'})])}, cos double"

    def fn(l: pa.Table, r: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if l.num_rows and r.num_rows:
            a, b, floor = _matrix(l, "vec"), _matrix(r, "vec").T, l.column("floor")[0].as_py()
            for at in range(0, len(a), STRIP):
                cos = a[at:at + STRIP] @ b
                x, y = np.nonzero(cos >= floor)
                found.append((x + at, y, cos[x, y]))
        x, y, cos = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        head = _repeat_key(l if l.num_rows else r, keys, len(x))
        return pa.table({**head, "i": l.column("id").take(pa.array(x)).combine_chunks(), "j": r.column("id").take(pa.array(y)).combine_chunks(), "cos": pa.array(cos, pa.float64())})

    return _apply(lefts, rights, keys, fn, schema)


def match_sets(
    left: DataFrame, right: DataFrame, keys: Sequence[str], threshold: float, per_row: int = PER_ROW, least: int = LEAST,
    block_rows: int = BLOCK_ROWS, bands: list | None = None,
) -> DataFrame:
    """``greedy_matching`` over all pairs with a cosine of at least ``threshold``: keys, i, j, cos, m.

    Both sides hold keys, id, unit vec and copies ``n``. ``bands``, where given, receives the number of pairs listed in each band.
    """
    keys = list(keys)
    left, right = (cut(d.select(*keys, "id", F.col("n").cast("bigint").alias("n"), "vec")) for d in (left, right))
    bases = left.select(*keys).distinct().withColumn("base", F.lit(float(threshold)))
    taken: DataFrame | None = None
    while True:
        floors = cut(_floors(left, right, bases, keys, per_row, least, block_rows))
        near = _pairs_from(left, right, floors, keys, block_rows)
        if bands is not None:
            near = cut(near)
            bands.append(near.count())
        now = cut(greedy_matching(near, left, right, keys))
        taken = now if taken is None else taken.unionByName(now)
        more = floors.where("not last")
        if more.isEmpty():
            return taken
        left, right = (_remaining(side, now, end, more, keys) for side, end in ((left, "i"), (right, "j")))
        bases = more.select(*keys, F.lit(float(threshold)).alias("base"))


def _remaining(side: DataFrame, taken: DataFrame, end: str, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with copies left, of keys that go on."""
    used = taken.groupBy(*keys, F.col(end).alias("id")).agg(F.sum("m").alias("_m"))
    rest = join_on(join_on(side, more.select(*keys), keys, "left_semi"), used, [*keys, "id"], "left")
    return cut(rest.withColumn("n", F.col("n") - F.coalesce("_m", F.lit(0))).where("n > 0").drop("_m"))
