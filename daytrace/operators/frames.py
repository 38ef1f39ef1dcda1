"""Screen recordings: segment bounds, frame times, and stable-state detection over frame signatures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from daytrace.functions import text as tx
from daytrace.operators.cuts import Cuts
from daytrace.operators.ordered import Ordered, chunked_fold, ordinal_chunk

# Fixed values -----------------------------------------------------------------------------------------
PIXEL_CHANGE = 10
CHANGE_PERCENT = 0.5
STABLE_SECONDS = 1.0
# ------------------------------------------------------------------------------------------------------


def segment_bounds(recordings: DataFrame, keys: Sequence[str], order: str, frames: str, duration: str, chunk_size: int | Cuts | None = 65_536) -> DataFrame:
    """Adds 1-based global ``start_idx``/``end_idx`` and ``fps`` from the running frame count."""
    out = (
        Ordered(recordings, keys, [order], ordinal_chunk(order, chunk_size))
        .running_sum("end_idx", F.col(frames))
        .done()
    )
    return out.withColumn("start_idx", F.col("end_idx") - F.col(frames) + 1).withColumn(
        "fps", F.col(frames) / F.col(duration)
    )


def locate_frames(frames: DataFrame, segments: DataFrame, keys: Sequence[str], carry: Sequence[str], chunk_size: int | Cuts | None = 1_048_576) -> DataFrame:
    """Frame index → segment with ``start_idx <= global_idx <= end_idx``, as an as-of fill (segments do not
    overlap).  Frames outside every segment keep a null segment, so a caller can quarantine or reject them."""
    keys, carry = list(keys), list(carry)
    own = [c for c in frames.columns if c not in {*keys, "global_idx"}]
    box = F.struct("start_idx", "end_idx", "fps", *carry)
    starts = segments.where(F.col("end_idx") >= F.col("start_idx")).select(
        *keys, F.col("start_idx").cast("bigint").alias("global_idx"), F.lit(0).alias("_kind"), box.alias("_segment"),
        *[F.lit(None).cast(frames.schema[c].dataType).alias(c) for c in own],
    )
    rows = frames.select(
        *keys, F.col("global_idx").cast("bigint"), F.lit(1).alias("_kind"),
        F.lit(None).cast(starts.schema["_segment"].dataType).alias("_segment"), *own,
    )
    filled = (
        Ordered(starts.unionByName(rows), keys, ["global_idx", "_kind"], ordinal_chunk("global_idx", chunk_size))
        .fill("_in", F.col("_segment"))
        .done()
    )
    inside = F.col("global_idx") <= F.col("_in.end_idx")
    hit = F.when(inside, F.col("_in"))
    return filled.where("_kind = 1").select(
        *keys, "global_idx", *own,
        hit["start_idx"].alias("start_idx"), hit["end_idx"].alias("end_idx"), hit["fps"].alias("fps"),
        ((F.col("global_idx") - hit["start_idx"]) / hit["fps"]).alias("video_offset_sec"),
        *[hit[c].alias(c) for c in carry],
    )


def frames_index(files: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index of frame files with source video, offset and wall-clock time.  ``segments`` carries
    ``start_time`` and ``video_source``.  Files with another name pattern are ignored."""
    named = files.withColumn("_p", tx.frame_parts("filename")).where("_p is not null")
    frames = named.select(*keys, "filename", F.col("_p.frame_id").alias("frame_id"), F.col("_p.global_idx").alias("global_idx"))
    placed = locate_frames(frames, segments, keys, ["start_time", "video_source"])
    ts = tx.frame_time(F.col("start_time"), F.col("fps"), F.col("start_idx"), F.col("global_idx"))
    return placed.select(
        *keys, "frame_id", "filename", "video_source", F.col("global_idx").alias("global_frame_idx"),
        "video_offset_sec", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp_iso"),
        (F.unix_micros(ts) / F.lit(1e6)).alias("timestamp_unix"),
    )


def changed_percent(a: Column, b: Column) -> Column:
    """Share of signature cells that differ by more than the pixel threshold, in percent."""
    diff = F.zip_with(a, b, lambda x, y: F.abs(x - y) > PIXEL_CHANGE)
    return F.size(F.filter(diff, lambda d: d)) * 100.0 / F.size(a)


def stable_start() -> dict:
    return {"saved": None, "cand": None, "at": None, "calm": 0, "n": 0}


def stable_step(change: float, seconds: float):
    """Step over ordered frames (seq, fps, sig): updates the state in place and returns the emitted frame, if
    any.  Shared by the batch and the streaming form; the state is plain JSON."""
    def moved(x: list, y: list | None) -> bool:
        if y is None:
            return True
        return np.mean(np.abs(np.subtract(x, y)) > PIXEL_CHANGE) * 100 > change

    def step(state: dict, row: tuple):
        seq, fps, sig = int(row[0]), row[1], [int(v) for v in row[2]]
        if not moved(sig, state["saved"]):
            state.update(cand=None, calm=0)
        elif state["cand"] is None or moved(sig, state["cand"]):
            state.update(cand=sig, at=seq, calm=0)
        else:
            state["calm"] += 1
            if state["calm"] >= int(fps * seconds):
                emitted = (state["n"], state["at"])
                state.update(saved=state["cand"], cand=None, calm=0, n=state["n"] + 1)
                return emitted
        return None

    return step


def stable_frames(
    frames: DataFrame, keys: Sequence[str], change: float = CHANGE_PERCENT, seconds: float = STABLE_SECONDS,
    chunk_size: int | Cuts | None = 8_192,
) -> DataFrame:
    """Frames that differ from the last saved one and then stay put for ``int(fps * seconds)`` more frames.

    Input per row: seq (dense from 1), fps, sig ARRAY<INT>.  State (saved and candidate signatures) is carried
    over chunks, so a long recording is folded in parallel.
    """
    return chunked_fold(
        frames, keys, ["seq"], ordinal_chunk("seq", chunk_size), ["seq", "fps", "sig"], stable_start,
        stable_step(change, seconds), "frame_id int, global_idx bigint",
    )
