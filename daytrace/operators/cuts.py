"""Cut points of single keys: ordered work splits a busy key where its rows are, however short the span they lie in.

One width for all keys leaves a burst whole and cuts a quiet key into dust. Here each key above the target gets cuts of
its own from a mergeable quantile sketch, which is filled map-side; only a number of heavy parts reaches the driver. A
part that is still too large is cut again, by the same column or, where all its rows share that value, by the next one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from daytrace.functions.common import join_on
from daytrace.session import cut, cut_counted

CHUNK = "_chunk"
FIRST_CHUNK = -(1 << 62)  # rows without an order value come first, as nulls do in a window
TARGET_ROWS = 250_000
PARTS = 256  # of one part in one level; two cuts a part at most, so places stay below 2 ** BITS
BITS = 10
GRID = 4 * PARTS  # quantiles are read at fixed ranks, of which each key takes those nearest to its own parts
LEVELS = 6  # 60 bits of a chunk number; far more than any number of rows needs
SKETCH = 4_096  # rank error about 0.1 %, a quarter of one of 256 parts
BROADCAST_PARTS = 10_000  # heavy parts, of at most 4 KB each, that may be broadcast; beyond it the join shuffles


def micros(ts: Column | str) -> Column:
    """Epoch microseconds of a timestamp with or without time zone (session zone: UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def _position(df: DataFrame, name: str) -> Column | None:
    """A whole number in the order of the column, or None where its type has none."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(micros(name), F.lit(FIRST_CHUNK))
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.col(name).cast("bigint"), F.lit(FIRST_CHUNK))
    return None


def _place(cuts: Column, value: Column) -> Column:
    """How many of the sorted cuts are at or below the value: a binary search over at most 1,023 of them."""
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(BITS))])
    return F.aggregate(halves, F.lit(0), lambda at, s: F.when(F.get(cuts, at + s - 1) <= value, at + s).otherwise(at))


@dataclass
class Cuts:
    """Cuts of the heavy keys, level by level; rows of other keys have one chunk. Made by ``fit``."""

    keys: list[str]
    order: list[str]
    levels: list[tuple[DataFrame, bool]] = field(default_factory=list)

    def _placed(self, df: DataFrame, positions: list[Column]) -> DataFrame:
        """``df`` with one column ``_c<level>`` a level."""
        for i, (table, small) in enumerate(self.levels):
            on = [*self.keys, *[f"_c{j}" for j in range(i)]]
            met = join_on(df, F.broadcast(table) if small else table, on, "left")
            value = F.element_at(F.array(*positions), F.col("_use"))
            here = F.when(F.col("_cuts").isNotNull(), _place(F.col("_cuts"), value)).otherwise(0)
            df = met.select(*df.columns, here.alias(f"_c{i}"))
        return df

    def split(self, df: DataFrame) -> DataFrame:
        """``df`` with ``CHUNK``, which is monotone in the fitted order columns inside a key."""
        placed = self._placed(df, [_position(df, c) for c in self.order])
        chunk = F.lit(0).cast("bigint")
        for i in range(len(self.levels)):
            chunk = F.shiftleft(chunk, BITS) + F.col(f"_c{i}")
        return placed.withColumn(CHUNK, chunk).select(*df.columns, CHUNK)


def fit(df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int = TARGET_ROWS) -> Cuts | None:
    """Cuts that leave no chunk above twice ``target_rows``, unless its rows agree in all the order columns that have a
    whole-number position (timestamps and integers, as far as the first column of another type). ``None`` when no key has
    more than ``target_rows`` rows: plain windows are then safe.

    Each level is a count by part and, where parts are too large, a sketch of these parts alone. Both read the key and order
    columns only and aggregate map-side. Null keys are a key, null positions come first; an empty table gives ``None``.
    """
    keys, named = list(keys), []
    for name in order:
        if _position(df, name) is None:
            break
        named.append(name)
    if not named:
        raise ValueError("the first order column must be a timestamp or an integer")
    where = [f"_p{i}" for i in range(len(named))]
    rows = df.select(*keys, *[_position(df, c).alias(p) for c, p in zip(named, where)])
    cuts = Cuts(keys, named)
    while len(cuts.levels) < LEVELS:
        on = [*keys, *[f"_c{i}" for i in range(len(cuts.levels))]]
        placed = cuts._placed(rows, [F.col(p) for p in where])
        spans = [x for p in where for x in (F.min(p).alias(f"_lo{p}"), F.max(p).alias(f"_hi{p}"))]
        sizes = placed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *spans)
        use = F.coalesce(*[F.when(F.col(f"_lo{p}") < F.col(f"_hi{p}"), i + 1) for i, p in enumerate(where)])
        low = F.element_at(F.array(*[F.col(f"_lo{p}") for p in where]), F.col("_use"))
        heavy = sizes.where(F.col("_n") > (2 * target_rows if cuts.levels else target_rows)).withColumn("_use", use)
        heavy, found = cut_counted(heavy.where("_use is not null").select(*on, "_n", "_use", low.alias("_low")))
        if not found:
            break
        small = found <= BROADCAST_PARTS
        chosen = join_on(placed, F.broadcast(heavy) if small else heavy, on)
        value = F.element_at(F.array(*where), F.col("_use"))
        sketched = chosen.groupBy(*on, "_n", "_use", "_low").agg(F.kll_sketch_agg_bigint(value, SKETCH).alias("_sketch"))
        parts = F.least(F.lit(PARTS), F.greatest(F.lit(2), F.ceil(F.col("_n") / target_rows))).cast("int")
        grid = F.kll_sketch_get_quantile_bigint("_sketch", F.array(*[F.lit(i / GRID) for i in range(1, GRID)]))
        picked = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_grid", F.floor(i * GRID / parts).cast("int") - 1))
        at = sketched.withColumn("_grid", grid).withColumn("_at", picked)
        # a value that fills a part by itself is set apart, so that the next level can cut it by the next column
        alone = F.filter("_at", lambda v, i: (v == F.col("_low")) | ((i > 0) & (F.get("_at", i - 1) == v)))
        points = F.array_sort(F.array_distinct(F.concat(F.col("_at"), F.transform(alone, lambda v: v + 1))))
        cuts.levels.append((cut(at.select(*on, "_use", points.alias("_cuts"))), small))
    return cuts if cuts.levels else None


def with_chunk(df: DataFrame, chunk: Column | Cuts) -> DataFrame:
    return chunk.split(df) if isinstance(chunk, Cuts) else df.withColumn(CHUNK, chunk)
