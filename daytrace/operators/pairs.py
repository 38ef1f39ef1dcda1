"""Observation pairs with rolling history, their time ranges, and batches of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from daytrace.operators.cuts import Cuts
from daytrace.operators.ordered import CHUNK, Ordered, chunked_fold, ordinal_chunk, with_halo


def pair_records(
    records: DataFrame, keys: Sequence[str], idx: str, payload: Sequence[str], history: int, chunk_size: int = 65_536
) -> DataFrame:
    """Non-overlapping pairs (0,1), (2,3), … of a dense ``idx``; an odd last row is dropped.

    ``first`` and ``second`` are structs of ``payload``; ``history`` holds up to ``history`` rows before the
    pair.  Rows near a chunk border travel to both chunks, so the frame never needs a whole key in one task.
    """
    if history < 1:
        raise ValueError("history must be at least 1")
    if chunk_size % 2 or chunk_size <= history:
        raise ValueError("chunk_size must be even and larger than the history")
    box = F.struct(*[F.col(c) for c in payload])
    row = Window.partitionBy(*keys, CHUNK).orderBy(idx)
    return (
        with_halo(records, idx, chunk_size, before=history)
        .withColumn("second", F.lead(box).over(row))
        .withColumn("history", F.collect_list(box).over(row.rowsBetween(-history, -1)))
        .where(F.col("_own") & (F.pmod(F.col(idx), F.lit(2)) == 0) & F.col("second").isNotNull())
        .select(*keys, F.expr(f"{idx} div 2").alias("pair_idx"), box.alias("first"), "second", "history")
    )


def pairs_within_budget(
    records: DataFrame, keys: Sequence[str], idx: str, tokens: str, history: int, budget: int,
    chunk_pairs: int | Cuts | None = 32_768,
) -> DataFrame:
    """Pairs whose tokens plus those of the rolling history fit ``budget``.  A skipped pair does not enter
    the history, so each decision depends on earlier ones: a chunked fold with the history as state."""
    if history < 1:
        raise ValueError("history must be at least 1")
    by_pair = (
        records.groupBy(*keys, F.expr(f"{idx} div 2").alias("pair_idx"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(idx).alias("first_id"), F.max(idx).alias("second_id"),
            F.min_by(tokens, idx).alias("_t1"), F.max_by(tokens, idx).alias("_t2"),
        )
        .where("_n = 2")
    )

    def step(state: dict, row: tuple):
        pair, a, b, ta, tb = (int(v) for v in row)
        recent = state["recent"]
        if ta + tb + sum(t for _, t in recent) > budget:
            return None
        state["recent"] = (recent + [[a, ta], [b, tb]])[-history:]
        return pair, a, b, [i for i, _ in recent]

    return chunked_fold(
        by_pair, keys, ["pair_idx"], ordinal_chunk("pair_idx", chunk_pairs),
        ["pair_idx", "first_id", "second_id", "_t1", "_t2"], lambda: {"recent": []}, step,
        "pair_idx bigint, first_id bigint, second_id bigint, history_ids array<bigint>",
    )


def _last_event(app: DataFrame, keys: Sequence[str]) -> DataFrame:
    return app.groupBy(*keys).agg(F.max_by("ts", "ord").alias("_last"))


def _event_time(pairs: DataFrame, app: DataFrame, keys: Sequence[str], position: Column, name: str) -> DataFrame:
    """Timestamp of the app event at ``position``; null beyond the end."""
    events = app.select(*keys, F.col("ord").alias("_pos"), F.col("ts").alias(name))
    return pairs.withColumn("_pos", position.cast("bigint")).join(events, [*keys, "_pos"], "left").drop("_pos")


def pair_ranges(pairs: DataFrame, app: DataFrame, keys: Sequence[str], modality: str) -> DataFrame:
    """Start and end time of a pair ``(a, b)`` from app events at fixed offsets (``ord`` is dense from 0).

    ``ax``: event a+1 to event b+2; ``metadata``: event a to event b+1.  Ends past the last event clamp to it;
    so does an ``ax`` start.
    """
    shift = {"ax": (1, 2), "metadata": (0, 1)}[modality]
    out = _event_time(pairs, app, keys, F.col("a") + shift[0], "_start")
    out = _event_time(out, app, keys, F.col("b") + shift[1], "_end")
    out = out.join(_last_event(app, keys), list(keys), "left")
    start = F.coalesce("_start", "_last") if modality == "ax" else F.col("_start")
    return out.select(*pairs.columns, start.alias("start"), F.coalesce("_end", "_last").alias("end"))


def event_times(records: DataFrame, app: DataFrame, keys: Sequence[str], modality: str) -> DataFrame:
    """Per record ``id``: its point time (``ax``) or its session window (``metadata``)."""
    as_pair = records.withColumn("a", F.col("id")).withColumn("b", F.col("id"))
    out = pair_ranges(as_pair, app, keys, modality).drop("a", "b")
    return out.drop("end").withColumnRenamed("start", "ts") if modality == "ax" else out


def frame_pair_ranges(pairs: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range of two frames by file name, earlier first; null when either has no time."""
    for side in ("1", "2"):
        look = frames.select(*keys, F.col("filename").alias(f"frame{side}"), F.col("ts").alias(f"_t{side}"))
        pairs = pairs.join(look, [*keys, f"frame{side}"], "left")
    both = F.col("_t1").isNotNull() & F.col("_t2").isNotNull()
    return (
        pairs.withColumn("start", F.when(both, F.least("_t1", "_t2")))
        .withColumn("end", F.when(both, F.greatest("_t1", "_t2")))
        .drop("_t1", "_t2")
    )


def join_layers(summaries: DataFrame, transcriptions: DataFrame, on: Sequence[str], keep_all: bool = False) -> DataFrame:
    """Summaries with their transcriptions: common pairs only, or every summary with '' for a missing text."""
    if not keep_all:
        return summaries.join(transcriptions, list(on), "inner")
    return summaries.join(transcriptions, list(on), "left").na.fill("", ["transcription"])


def observation_text(pair: Column, summary: Column, transcription: Column) -> Column:
    def part(title: str, body: Column) -> Column:
        return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), body, F.lit("\n\n"))).otherwise("")

    return F.concat(
        F.lit("--- Pair "), pair.cast("string"), F.lit(" ---\n\n"), part("Summary", summary),
        part("Transcription", transcription),
    )


def batch_observations(
    pairs: DataFrame, keys: Sequence[str], k: int, chunk_size: int | Cuts | None = 65_536
) -> DataFrame:
    """Batches of ``k`` pairs in pair order: texts joined by a line break, the pair list and the time range.

    Needs pair_idx, summary, transcription, start, end.  ``missing_ranges`` counts pairs without a range.
    """
    keys = list(keys)
    placed = Ordered(pairs, keys, ["pair_idx"], ordinal_chunk("pair_idx", chunk_size)).ordinal("_n").done()
    one = F.struct(
        F.col("pair_idx"),
        observation_text(F.col("pair_idx"), F.col("summary"), F.col("transcription")).alias("text"),
    )
    ranged = F.col("start").isNotNull()
    batches = placed.groupBy(*keys, F.expr(f"_n div {int(k)}").alias("batch_id")).agg(
        F.sort_array(F.collect_list(one)).alias("_rows"),
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.count_if(~ranged).alias("missing_ranges"),
    )
    return batches.select(
        *keys, "batch_id",
        F.transform("_rows", lambda r: r["pair_idx"]).alias("pair_indices"),
        F.array_join(F.transform("_rows", lambda r: r["text"]), "\n").alias("content"),
        "start", "end", "missing_ranges",
    )
