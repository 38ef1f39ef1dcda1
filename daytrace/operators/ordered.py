"""Order-dependent columns (lead, lag, ordinal, fill, running totals) and ordered folds.

A plain ``Window.partitionBy(key)`` puts a whole key into one task, and one key may hold a third of all
rows.  Everything here works on (key, chunk) instead, where the chunk is a monotone bucket of the order
column: rows are ranked inside their chunk, and one summary row per chunk carries the value across chunk
borders.  The summaries are aggregated map-side, so only they meet in one place per key.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from daytrace.functions.common import join_on
from daytrace.operators.cuts import CHUNK, FIRST_CHUNK, Cuts, micros, with_chunk
from daytrace.session import cut

DAY = 86_400


def time_chunk(ts: Column | str, seconds: int | Cuts | None = DAY) -> Column | Cuts | None:
    """Chunks of one width; ``Cuts`` (of single keys) and ``None`` (plain windows) pass through."""
    if seconds is None or isinstance(seconds, Cuts):
        return seconds
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def ordinal_chunk(ordinal: Column | str, size: int | Cuts | None = 65_536) -> Column | Cuts | None:
    if size is None or isinstance(size, Cuts):
        return size
    c = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(c / F.lit(size)).cast("bigint")


def fitting_width(df: DataFrame, keys: Sequence[str], position: Column, target_rows: int = 250_000) -> int | None:
    """Chunk width, in units of ``position``, that gives the largest key about ``target_rows`` rows per chunk.
    ``None`` when no key has more rows than that, so that plain windows are safe.

    One small job over the key and position columns: per-key counts aggregate map-side and only three numbers
    reach the driver. For rows that are spread evenly, as dense ordinals are; ``cuts.fit`` cuts each key where its rows lie.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("lo"), F.max(position).alias("hi"))
    n, lo, hi = per_key.agg(F.max("n"), F.min("lo"), F.max("hi")).first()
    if n is None or n <= target_rows:
        return None
    return max(1, math.ceil((hi - lo + 1) / math.ceil(n / target_rows)))


def fitting_seconds(df: DataFrame, keys: Sequence[str], ts: str = "ts", target_rows: int = 250_000) -> int | None:
    return fitting_width(df, keys, F.floor(micros(ts) / F.lit(1_000_000)), target_rows)


def fitting_size(df: DataFrame, keys: Sequence[str], ordinal: str, target_rows: int = 250_000) -> int | None:
    return fitting_width(df, keys, F.col(ordinal), target_rows)


class Ordered:
    """Collects order-dependent columns over ``keys`` and computes them in one pass.

    ``chunk`` is a column that is monotone in the first ``order`` column, or ``Cuts`` fitted on leading ``order`` columns and
    some of ``keys``; ``None`` means plain windows, for keys known to be small.  ``order`` should be a total order per key.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | Cuts | None):
        self.df, self.keys, self.order = df, list(keys), list(order)
        self.whole = chunk is None
        self.base = df if self.whole else with_chunk(df, chunk)
        parts = self.keys if self.whole else [*self.keys, CHUNK]
        self.row = Window.partitionBy(*parts).orderBy(*self.order)
        self.cross = Window.partitionBy(*self.keys).orderBy(CHUNK)
        self.position = F.struct(*[F.col(c) for c in self.order])
        self.local: dict[str, Column] = {}
        self.summary: dict[str, Column] = {}
        self.across: dict[str, Column] = {}
        self.final: dict[str, Column] = {}
        self.filled: list[Column] = []

    def _edge(self, name: str, value: Column, ahead: bool) -> "Ordered":
        boxed = F.struct(value.alias("v"))
        pick, shift = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
        self.local[f"_l_{name}"] = shift(boxed).over(self.row)
        if self.whole:
            self.final[name] = F.col(f"_l_{name}")["v"]
            return self
        self.summary[f"_s_{name}"] = pick(boxed, self.position)
        self.across[f"_a_{name}"] = shift(F.col(f"_s_{name}")).over(self.cross)
        self.final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_a_{name}"))["v"]
        return self

    def lead(self, name: str, value: Column) -> "Ordered":
        return self._edge(name, value, ahead=True)

    def lag(self, name: str, value: Column) -> "Ordered":
        return self._edge(name, value, ahead=False)

    def ordinal(self, name: str) -> "Ordered":
        """0-based position in the key."""
        before = self.cross.rowsBetween(Window.unboundedPreceding, -1)
        self.local[f"_l_{name}"] = F.row_number().over(self.row)
        if self.whole:
            self.final[name] = (F.col(f"_l_{name}") - 1).cast("bigint")
            return self
        self.summary[f"_s_{name}"] = F.count(F.lit(1))
        self.across[f"_a_{name}"] = F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0))
        self.final[name] = (F.col(f"_a_{name}") + F.col(f"_l_{name}") - 1).cast("bigint")
        return self

    def fill(self, name: str, value: Column) -> "Ordered":
        """Latest non-null ``value`` at or before the row."""
        upto = self.row.rowsBetween(Window.unboundedPreceding, 0)
        before = self.cross.rowsBetween(Window.unboundedPreceding, -1)
        self.local[f"_l_{name}"] = F.last(value, ignorenulls=True).over(upto)
        if self.whole:
            self.final[name] = F.col(f"_l_{name}")
            return self
        self.summary[f"_s_{name}"] = F.max_by(value, F.when(value.isNotNull(), self.position))
        self.across[f"_a_{name}"] = F.last(F.col(f"_s_{name}"), ignorenulls=True).over(before)
        self.final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_a_{name}"))
        self.filled.append(value)
        return self

    def _running(self, name: str, value: Column, agg, merge) -> "Ordered":
        upto = self.row.rowsBetween(Window.unboundedPreceding, 0)
        before = self.cross.rowsBetween(Window.unboundedPreceding, -1)
        self.local[f"_l_{name}"] = agg(value).over(upto)
        if self.whole:
            self.final[name] = merge(F.col(f"_l_{name}"), F.lit(None))
            return self
        self.summary[f"_s_{name}"] = agg(value)
        self.across[f"_a_{name}"] = agg(F.col(f"_s_{name}")).over(before)
        self.final[name] = merge(F.col(f"_l_{name}"), F.col(f"_a_{name}"))
        return self

    def running_sum(self, name: str, value: Column) -> "Ordered":
        return self._running(name, value, F.sum, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))

    def running_max(self, name: str, value: Column) -> "Ordered":
        return self._running(name, value, F.max, lambda x, y: F.greatest(x, y))

    def _summaries(self) -> DataFrame:
        on = [*self.keys, CHUNK]
        aggregates = [c.alias(n) for n, c in self.summary.items()]
        if len(self.filled) < len(self.summary):
            return self.base.groupBy(*on).agg(*aggregates)
        # Only fills: rows without a value add nothing but their chunk, so just the few rows with one are
        # aggregated by position, and the chunks come from a plain hash aggregate.
        some = self.base.where(F.coalesce(*[F.when(v.isNotNull(), True) for v in self.filled], F.lit(False)))
        return join_on(self.base.select(*on).distinct(), some.groupBy(*on).agg(*aggregates), on, "left")

    def done(self) -> DataFrame:
        rows = self.base.select("*", *[c.alias(n) for n, c in self.local.items()])
        finals = [c.alias(n) for n, c in self.final.items()]
        if self.whole:
            return rows.select(*self.df.columns, *finals)
        carried = self._summaries().select(*self.keys, CHUNK, *[c.alias(n) for n, c in self.across.items()])
        return join_on(rows, carried, [*self.keys, CHUNK]).select(*self.df.columns, *finals)


def with_halo(df: DataFrame, ordinal: str, size: int, before: int, after: int = 0) -> DataFrame:
    """Chunk rows by a dense ordinal and copy the ``before`` last rows of a chunk into the next one (and
    the ``after`` first rows into the previous one), marked ``_own = false``.  A row frame no wider than
    the halo is then exact on ``Window.partitionBy(key, chunk)``.  ``size`` must exceed both halos."""
    o = F.col(ordinal)
    own = F.floor(o / size).cast("bigint")
    place = F.pmod(o, F.lit(size))
    homes = F.array_compact(
        F.array(
            own,
            F.when(place >= size - before, own + 1) if before else F.lit(None).cast("bigint"),
            F.when((place < after) & (own > 0), own - 1) if after else F.lit(None).cast("bigint"),
        )
    )
    return df.withColumn(CHUNK, F.explode(homes)).withColumn("_own", F.col(CHUNK) == own)


def fold_sorted(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], fields: Sequence[str],
    start: Callable, step: Callable, finish: Callable, out_schema: T.StructType,
) -> DataFrame:
    """Ordered fold of every group, streamed: rows are hash-partitioned by ``groups``, sorted, and passed once
    through the task in Arrow batches, so no group is ever held as a whole.

    ``start(group) -> state``, ``step(state, row) -> output tuple or None`` (the state is updated in place),
    ``finish(group, state) -> list of output tuples``.  ``row`` holds ``fields``.
    """
    import pandas as pd

    groups, fields = list(groups), list(fields)
    names = [f.name for f in out_schema.fields]
    width = len(groups)

    def run(batches):
        here, state = None, None
        for pdf in batches:
            out = []
            for row in zip(*[pdf[c] for c in [*groups, *fields]]):
                group = tuple(None if v != v else v for v in row[:width])  # pandas shows a null number as NaN
                if group != here:
                    if here is not None:
                        out.extend(finish(here, state))
                    here, state = group, start(group)
                made = step(state, row[width:])
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)
        if here is not None:
            yield pd.DataFrame(finish(here, state), columns=names)

    rows = df.select(*groups, *order, *[f for f in fields if f not in {*groups, *order}])
    return rows.repartition(*groups).sortWithinPartitions(*groups, *order).mapInPandas(run, out_schema)


def chunked_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | Cuts | None, fields: Sequence[str],
    start: Callable, step: Callable, out_schema: str, max_rounds: int = 10_000,
) -> DataFrame:
    """Ordered fold with carried state, spread over chunks instead of one task per key.

    ``start() -> state`` (a JSON-able dict) and ``step(state, row) -> output tuple or None`` as in
    ``fold_sorted``.  Round 0 folds every chunk from the start state; each later round re-folds only the chunks
    whose predecessor ended in another state than the one they started from.  It stops when no chunk is stale,
    which is the sequential result.  Automata that soon forget their past settle in a round or two; the worst
    case is one round per chunk, never a whole key in one task.  ``chunk=None`` folds each key at once, for
    keys known to be small.
    """
    keys = list(keys)
    if isinstance(chunk, Cuts):
        base = chunk.split(df)
    else:
        base = df.withColumn(CHUNK, F.lit(0).cast("bigint") if chunk is None else F.coalesce(chunk, F.lit(FIRST_CHUNK)))
    out_type = T._parse_datatype_string(out_schema)
    full = T.StructType(
        [base.schema[k] for k in keys]
        + [T.StructField(CHUNK, T.LongType()), T.StructField("_state", T.StringType()), T.StructField("_out", out_type)]
    )
    names = [f.name for f in out_type.fields]
    width = len(keys) + 1  # keys and chunk; the given state is the last group column

    def begin(group: tuple) -> dict:
        return {"head": group[:width], "fold": json.loads(group[width]) if group[width] else start()}

    def advance(state: dict, row: tuple):
        made = step(state["fold"], row)
        return None if made is None else (*state["head"], None, dict(zip(names, made)))

    def end(group: tuple, state: dict) -> list:
        return [(*group[:width], json.dumps(state["fold"]), None)]

    def fold(rows: DataFrame) -> DataFrame:
        return fold_sorted(rows, [*keys, CHUNK, "_given"], order, fields, begin, advance, end, full)

    if chunk is None:
        only = fold(base.withColumn("_given", F.lit("")))
        return only.where("_out is not null").select(*keys, "_out.*")
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    done = cut(fold(base.withColumn("_given", F.lit(""))))
    used = done.where("_out is null").select(*keys, CHUNK, F.lit("").alias("_used"))
    for _ in range(max_rounds):
        ends = done.where("_out is null").select(*keys, CHUNK, "_state")
        due = ends.select(*keys, CHUNK, F.coalesce(F.lag("_state").over(across), F.lit("")).alias("_given"))
        stale = cut(join_on(due, used, [*keys, CHUNK]).where("_given != _used").drop("_used"))
        if stale.isEmpty():
            break
        redone = stale.select(*keys, CHUNK)
        kept = join_on(done, redone, [*keys, CHUNK], "left_anti")
        done = cut(kept.unionByName(fold(join_on(base, stale, [*keys, CHUNK]))))
        used = cut(join_on(used, redone, [*keys, CHUNK], "left_anti").unionByName(stale.withColumnRenamed("_given", "_used")))
    else:
        raise RuntimeError("ordered fold did not settle")
    return done.where("_out is not null").select(*keys, "_out.*")
