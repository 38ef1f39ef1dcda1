"""App-bounded sessions, as-of assignment of input events, and per-session metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from daytrace.functions import text as tx
from daytrace.operators.cuts import Cuts
from daytrace.operators.ordered import CHUNK, DAY, Ordered, micros, ordinal_chunk, time_chunk

# Fixed values -----------------------------------------------------------------------------------------
MOUSE_TYPES = ["mouse_click", "drag"]
KEYBOARD_TYPES = ["key_modifier", "key_press"]
JUMP_PX = 3000.0
PAUSE_SEC = 2.0
CHARS_PER_WORD = 5
# ------------------------------------------------------------------------------------------------------


def filter_range(events: DataFrame, start, end, types: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows of the given types with ``start <= ts < end``; both conditions reach the scan."""
    return events.where(F.col("event_type").isin(list(types)) & (F.col(ts) >= start) & (F.col(ts) < end))


def build_sessions(app: DataFrame, keys: Sequence[str], chunk_seconds: int | Cuts | None = DAY) -> DataFrame:
    """One session per consecutive pair of app events ``(ts, ord)``: adds session_id, start, end, duration.
    The last app event of a key opens no session."""
    keys = list(keys)
    rows = (
        Ordered(app, keys, ["ts", "ord"], time_chunk("ts", chunk_seconds))
        .lead("end", F.col("ts"))
        .ordinal("session_id")
        .done()
    )
    return (
        rows.where(F.col("end").isNotNull())
        .withColumnRenamed("ts", "start")
        .withColumn("duration", (micros("end") - micros("start")) / F.lit(1e6))
    )


def assign_events(
    sessions: DataFrame, events: DataFrame, keys: Sequence[str], chunk_seconds: int | Cuts | None = DAY
) -> DataFrame:
    """Each event gets the session with ``start <= ts < end``; events outside every session are dropped.

    Written as an as-of fill over the union of session starts and events, so its cost is one sort by
    (key, time chunk) instead of a sessions × events comparison.
    """
    keys = list(keys)
    carried = [c for c in events.columns if c not in keys and c != "ts"]
    box = F.struct("session_id", "start", "end")
    starts = sessions.select(
        *keys, F.col("start").alias("ts"), F.lit(0).alias("_kind"), F.col("session_id").alias("_tie"),
        box.alias("_session"),
        *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in carried],
    )
    rows = events.select(
        *keys, "ts", F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_tie"),
        F.lit(None).cast(starts.schema["_session"].dataType).alias("_session"), *carried,
    )
    filled = (
        Ordered(starts.unionByName(rows), keys, ["ts", "_kind", "_tie"], time_chunk("ts", chunk_seconds))
        .fill("_in", F.col("_session"))
        .done()
    )
    return filled.where((F.col("_kind") == 1) & (F.col("ts") < F.col("_in.end"))).select(
        *keys, F.col("_in.session_id").alias("session_id"), "ts", *carried
    )


def mouse_metrics(
    assigned: DataFrame,
    keys: Sequence[str],
    move_type: str = "mouse_move",
    click: Column | None = None,
    jump: float = JUMP_PX,
    digits: int = 2,
    chunk_seconds: int | Cuts | None = DAY,
) -> DataFrame:
    """Per session: path length, mean speed, clicks and bounding-box area; no row when it has < 2 events.

    ``keys`` include the session.  A jump of ``jump`` or more adds nothing but still moves the last point.
    """
    keys = list(keys)
    if click is None:
        click = (F.col("event_type") == "mouse_click") & (F.col("action") == "down")
    located = F.col("x").isNotNull() & F.col("y").isNotNull()
    is_move = (F.col("event_type") == move_type) & located
    order = ["ts", "ord"]
    moves = (
        Ordered(assigned.where(is_move), keys, order, time_chunk("ts", chunk_seconds))
        .lag("px", F.col("x"))
        .lag("py", F.col("y"))
        .done()
    )
    step = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    paths = moves.groupBy(*keys).agg(F.sum(F.when(step < jump, step)).alias("_path"))
    boxes = assigned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        ((F.max(micros("ts")) - F.min(micros("ts"))) / F.lit(1e6)).alias("_dur"),
        F.count_if(click).alias("click_count"),
        F.max(F.when(located, F.col("x"))).alias("_x1"), F.min(F.when(located, F.col("x"))).alias("_x0"),
        F.max(F.when(located, F.col("y"))).alias("_y1"), F.min(F.when(located, F.col("y"))).alias("_y0"),
    )
    path = F.coalesce(F.col("_path"), F.lit(0.0))
    return (
        boxes.where(F.col("_n") >= 2)
        .join(paths, keys, "left")
        .select(
            *keys,
            F.round(path, digits).alias("total_distance_px"),
            F.round(F.when(F.col("_dur") > 0, path / F.col("_dur")).otherwise(0.0), digits).alias("avg_speed_px_s"),
            "click_count",
            F.round(
                F.coalesce((F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")), F.lit(0.0)), digits
            ).alias("screen_area_used"),
        )
    )


def typing_metrics(
    presses: DataFrame,
    keys: Sequence[str],
    pause: float = PAUSE_SEC,
    chunk_size: int | Cuts | None = 65_536,
    time_digits: int = 4,
) -> DataFrame:
    """Per session over key presses ``(ord, timestamp_precise)`` in arrival order: rates and flight times.

    A gap counts only when both neighbours carry a precise time; gaps of ``pause`` or more are left out.
    Callers pass only ``key_press`` rows; sessions with one press get zeros and a note.
    """
    keys = list(keys)
    rows = (
        Ordered(presses, keys, ["ord"], ordinal_chunk("ord", chunk_size))
        .lead("next_time", F.col("timestamp_precise"))
        .done()
    )
    flight = F.col("next_time") - F.col("timestamp_precise")
    kept = F.when(flight < pause, flight)
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_presses"),
        F.count(kept).alias("_n"),
        F.coalesce(F.sum(kept), F.lit(0.0)).alias("_total"),
        F.avg(kept).alias("_avg"),
        F.stddev_samp(kept).alias("_sd"),
    )
    some = (F.col("_presses") >= 2) & (F.col("_n") > 0)
    moving = some & (F.col("_total") > 0)
    strokes = (F.col("_n") + 1).cast("double")
    zero = F.lit(0.0)
    return stats.select(
        *keys,
        F.round(F.when(moving, strokes / F.col("_total")).otherwise(zero), 2).alias("kps"),
        F.round(
            F.when(moving, strokes / CHARS_PER_WORD / (F.col("_total") / 60)).otherwise(zero), 2
        ).alias("wpm"),
        F.round(F.when(some, F.col("_avg")).otherwise(zero), time_digits).alias("avg_flight_time"),
        F.round(F.when(some, F.coalesce(F.col("_sd"), zero)).otherwise(zero), time_digits).alias("flight_time_sd"),
        F.when(some, F.col("_n")).alias("sample_size"),
        F.when(F.col("_presses") < 2, F.lit("Insufficient data")).alias("note"),
    )


def merge_repeats(
    rows: DataFrame, keys: Sequence[str], same: Sequence[str], order: Sequence[str], chunk: Column | Cuts | None,
    measure: str = "duration",
) -> DataFrame:
    """Gaps and islands: consecutive rows equal on ``same`` collapse to their first row, ``measure`` is
    summed and ``id`` re-counts from 0."""
    keys, same, order = list(keys), list(same), list(order)
    here = F.struct(*[F.col(c) for c in same])
    marked = Ordered(rows, keys, order, chunk).lag("_before", here).done()
    # The first row of a key has no row before it; a struct of nulls differs from no struct at all.
    first = F.col("_before").isNull() | ~F.col("_before").eqNullSafe(here)
    marked = marked.withColumn("_new", F.when(first, 1).otherwise(0))
    islands = Ordered(marked, keys, order, chunk).running_sum("_island", F.col("_new")).done()
    kept = [c for c in rows.columns if c not in {*keys, measure}]
    merged = islands.groupBy(*keys, "_island").agg(
        F.min_by(F.struct(*kept), F.struct(*order)).alias("_first"), F.sum(measure).alias(measure)
    )
    return merged.select(*keys, (F.col("_island") - 1).cast("bigint").alias("id"), "_first.*", measure)


def metadata_records(
    sessions: DataFrame, mouse: DataFrame, typing: DataFrame, texts: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Clean session records: app fields plus nested metrics that are null where a session had no input.
    ``sessions`` carries the app event in ``data``; the other three are keyed by ``keys + session_id``."""
    on = [*keys, "session_id"]
    mouse_box = mouse.select(*on, F.struct(*[c for c in mouse.columns if c not in on]).alias("mouse_metrics"))
    typing_box = typing.select(*on, F.struct(*[c for c in typing.columns if c not in on]).alias("typing_metrics"))
    text_box = texts.select(*on, F.struct(F.col("text").alias("main_text")).alias("keyboard_transcription"))
    return (
        sessions.join(mouse_box, on, "left").join(typing_box, on, "left").join(text_box, on, "left")
        .select(
            *keys, F.col("session_id").alias("id"), "duration",
            F.col("data.action").alias("trigger_action"), F.col("data.app_name").alias("app_name"),
            tx.window_info(F.col("data")).alias("windows_names"),
            "mouse_metrics", "typing_metrics", "keyboard_transcription",
        )
    )


def activity_counts(sessions: DataFrame, assigned: DataFrame, keys: Sequence[str], types: Sequence[str]) -> DataFrame:
    """Every session with its number of events per type; sessions without events stay with zeros."""
    on = [*keys, "session_id"]
    counts = assigned.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in types],
    )
    joined = sessions.join(counts, on, "left")
    return joined.na.fill(0, ["n_events", *[f"n_{t}" for t in types]])


def drop_chunk(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK, "_own")
