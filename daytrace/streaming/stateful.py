"""Structured Streaming forms of the time-shaped operators.

Rows may come in any order inside the declared delay: they wait in keyed list state until the watermark has passed them, are then
folded in event-time order, and so give the batch result.  State per key is what waits (the rows of one delay) and what the fold
remembers: an open session, the memories inside the novelty window, or two frame signatures.  Only rows behind the watermark are
lost, as the delay says.  The last open session never closes, as in batch.  Queries need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``, set by ``session.build_session``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from daytrace.operators.frames import CHANGE_PERCENT, STABLE_SECONDS, stable_start, stable_step


def _keyed(stream: DataFrame, key: str, fold, schema: str) -> DataFrame:
    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True)
        out, memory = fold(rows, memory)
        state.update((json.dumps(memory),))
        out.insert(0, key, k[0])
        yield out

    key_type = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} {key_type}, {schema}", "memory string", "append", GroupStateTimeout.NoTimeout)


def _plain(rows) -> list[tuple]:
    """Rows with NumPy's values as Python's, as list state takes them."""
    return [tuple(v.tolist() if hasattr(v, "tolist") else v for v in row) for row in rows]


class InOrder(StatefulProcessor):
    """Folds the rows of a key in event-time order, each as soon as the watermark has passed it.

    Rows carry ``us`` (event time in microseconds) and the fields that the fold needs. A timer stands at the earliest waiting row;
    when it fires, all rows before the watermark are folded together and the timer moves on.
    """

    def __init__(self, key: str, fields: T.StructType, out: T.StructType, fold):
        self.key, self.fields, self.out, self.fold = key, fields, out, fold

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.memory = handle.getValueState("memory", T.StructType([T.StructField("json", T.StringType())]))
        self.due = handle.getValueState("due", T.StructType([T.StructField("ms", T.LongType())]))

    def _wait_until(self, earliest_us: int) -> None:
        at = earliest_us // 1000 + 1
        if self.due.exists():
            standing = self.due.get()[0]
            if standing <= at:
                return
            self.handle.deleteTimer(standing)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        names = self.fields.fieldNames()
        earliest = None
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList(_plain(zip(*[pdf[n] for n in names])))
                first = int(pdf["us"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wait_until(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.due.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        names = self.fields.fieldNames()
        held = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=names)
        ready, later = held[held["us"] < passed], held[held["us"] >= passed]
        if len(later):
            self.waiting.put(_plain(later.itertuples(index=False, name=None)))
            self._wait_until(int(later["us"].min()))
        else:
            self.waiting.clear()
        if not len(ready):
            return
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else None
        out, memory = self.fold(ready, memory)
        self.memory.update((json.dumps(memory),))
        out.insert(0, self.key, key[0])
        yield out

    def close(self) -> None:
        pass


def _in_order(stream: DataFrame, key: str, ts: str, delay: str, fields: list[str], fold, schema: str) -> DataFrame:
    """Rows of ``stream`` folded in the order of ``ts``: ``fields`` and ``us`` reach the fold; rows without a time are left out."""
    us = F.unix_micros(F.col(ts).cast("timestamp")).alias("us")
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(key, ts, us, *fields)
    kept = T.StructType([rows.schema[c] for c in ["us", *fields]])
    out = T.StructType([stream.schema[key], *T._parse_datatype_string(schema).fields])
    return rows.groupBy(key).transformWithStateInPandas(InOrder(key, kept, out, fold), out, "Append", "EventTime")


def stream_sessions(stream: DataFrame, key: str = "user", boundary: str = "app", delay: str = "10 minutes") -> DataFrame:
    """Sessions bounded by ``boundary`` events, emitted when the watermark has passed the next boundary: session_id, start_us,
    end_us, n_events.  Input: ts, event_type."""

    def fold(pdf: pd.DataFrame, memory):
        memory = memory or {"id": -1, "start": None, "n": 0}
        out = []
        # boundaries first among equal times: an event at a boundary belongs to the new session
        for us, opens in pdf.sort_values(["us", "opens"], ascending=[True, False])[["us", "opens"]].itertuples(index=False):
            if opens:
                if memory["start"] is not None:
                    out.append((memory["id"], memory["start"], int(us), memory["n"]))
                memory.update(id=memory["id"] + 1, start=int(us), n=0)
            elif memory["start"] is not None:
                memory["n"] += 1
        return pd.DataFrame(out, columns=["session_id", "start_us", "end_us", "n_events"]), memory

    rows = stream.withColumn("opens", F.coalesce(F.col("event_type") == boundary, F.lit(False)))
    return _in_order(rows, key, "ts", delay, ["opens"], fold, "session_id bigint, start_us bigint, end_us bigint, n_events bigint")


def stream_assigned(stream: DataFrame, key: str = "user", boundary: str = "app", delay: str = "10 minutes") -> DataFrame:
    """Every event between boundaries with its session, once the watermark has passed it: session_id, start_us, us, event_type. Events
    before the first boundary have none and are left out; those of the session that is still open come, too."""

    def fold(pdf: pd.DataFrame, memory):
        memory = memory or {"id": -1, "start": None}
        out = []
        for us, opens, kind in pdf.sort_values(["us", "opens"], ascending=[True, False])[["us", "opens", "event_type"]].itertuples(index=False):
            if opens:
                memory = {"id": memory["id"] + 1, "start": int(us)}
            elif memory["start"] is not None:
                out.append((memory["id"], memory["start"], int(us), kind))
        return pd.DataFrame(out, columns=["session_id", "start_us", "us", "event_type"]), memory

    rows = stream.withColumn("opens", F.coalesce(F.col("event_type") == boundary, F.lit(False)))
    return _in_order(rows, key, "ts", delay, ["opens", "event_type"], fold, "session_id bigint, start_us bigint, us bigint, event_type string")


def stream_novelty(
    stream: DataFrame, key: str = "user", threshold: float = 0.8, window: float = 2.0, ts: str | None = None, delay: str = "10 minutes",
) -> DataFrame:
    """Online novelty gate over (id, t, vec): emits every item with ``kept`` and the absorbing id.  Memories
    older than the window are evicted, so state follows the window and not the stream.  With ``ts``, the event time that ``t``
    grows with, items may come in any order inside ``delay``; without it they have to come in order."""
    def fold(pdf: pd.DataFrame, memory):
        memory = memory or []
        out = []
        for i, t, vec in pdf.sort_values(["t", "id"])[["id", "t", "vec"]].itertuples(index=False):
            memory = [m for m in memory if t - m[1] <= window]
            into = None
            if memory:
                sims = np.array([m[2] for m in memory]) @ np.asarray(vec, dtype=float)
                best = int(np.argmax(sims))
                into = memory[best][0] if sims[best] >= threshold else None
            if into is None:
                memory.append([int(i), float(t), [float(v) for v in vec]])
            out.append((int(i), into is None, into))
        return pd.DataFrame(out, columns=["id", "kept", "into"]).astype({"into": "Int64"}), memory

    schema = "id bigint, kept boolean, into bigint"
    if ts:
        return _in_order(stream, key, ts, delay, ["id", "t", "vec"], fold, schema)
    return _keyed(stream.select(key, "id", "t", "vec"), key, fold, schema)


def stream_stable_frames(
    stream: DataFrame, key: str = "user", change: float = CHANGE_PERCENT, seconds: float = STABLE_SECONDS
) -> DataFrame:
    """Stable-state detection over ordered frame signatures (seq, fps, sig)."""
    step = stable_step(change, seconds)

    def fold(pdf: pd.DataFrame, memory):
        memory = memory or stable_start()
        made = [step(memory, row) for row in pdf.sort_values("seq")[["seq", "fps", "sig"]].itertuples(index=False)]
        return pd.DataFrame([m for m in made if m], columns=["frame_id", "global_idx"]), memory

    return _keyed(stream.select(key, "seq", "fps", "sig"), key, fold, "frame_id int, global_idx bigint")


def stream_windows(stream: DataFrame, key: str, seconds: int, anchor_seconds: int = 0, delay: str = "10 minutes") -> DataFrame:
    """Tumbling windows with a fixed anchor: counts per key, window and event type; late rows are dropped."""
    win = F.window("ts", f"{seconds} seconds", startTime=f"{anchor_seconds % seconds} seconds")
    return (
        stream.withWatermark("ts", delay).groupBy(key, win.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.unix_micros("w.start").alias("start_us"), "event_type", "n")
    )
