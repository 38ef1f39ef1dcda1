from conftest import rows
from pyspark.sql import functions as F

from daytrace.operators import pairs, sessions
from daytrace.operators.frames import frames_index, segment_bounds, stable_frames
from daytrace.operators.keystrokes import typed_text
from daytrace.operators.ordered import ordinal_chunk


def at(sec):
    return F.timestamp_seconds(F.lit(1_700_000_000) + sec)


def log(spark, data, schema):
    return spark.createDataFrame(data, schema).withColumn("ts", at(F.col("s"))).drop("s")


def test_sessions_are_half_open_and_keep_empty_ones(spark):
    app = log(spark, [("u", 0, 0.0), ("u", 1, 10.0), ("u", 2, 20.0), ("v", 0, 5.0)], "user string, ord long, s double")
    ev = log(spark, [("u", 0, -1.0, "a"), ("u", 1, 0.0, "a"), ("u", 2, 9.9, "a"), ("u", 3, 10.0, "a"), ("u", 4, 20.0, "a"), ("v", 0, 6.0, "a")],
             "user string, ord long, s double, event_type string")
    for chunk in (1, 7, 86_400, None):
        ses = sessions.build_sessions(app, ["user"], chunk)
        assert rows(ses, "user", "session_id", "duration") == [("u", 0, 10.0), ("u", 1, 10.0)]
        got = sessions.assign_events(ses, ev, ["user"], chunk)
        assert rows(got, "user", "ord", "session_id") == [("u", 1, 0), ("u", 2, 0), ("u", 3, 1)]
    empty = sessions.activity_counts(ses, got.where("session_id = 0"), ["user"], ["a"])
    assert rows(empty, "session_id", "n_events") == [(0, 2), (1, 0)]


def test_mouse_metrics(spark):
    data = [("u", 0, 0, 0.0, "mouse_move", 0.0, 0.0, None), ("u", 0, 1, 1.0, "mouse_move", 3.0, 4.0, None),
            ("u", 0, 2, 2.0, "mouse_move", 9000.0, 4.0, None), ("u", 0, 3, 3.0, "mouse_move", 9000.0, 10.0, None),
            ("u", 0, 4, 4.0, "mouse_click", None, None, "down"), ("u", 1, 5, 9.0, "mouse_click", 1.0, 1.0, "down")]
    df = log(spark, data, "user string, session_id long, ord long, s double, event_type string, x double, y double, action string")
    got = sessions.mouse_metrics(df, ["user", "session_id"], chunk_seconds=1)
    # the jump of 8997 px adds nothing but moves the last point, so the next step is 6
    assert [tuple(r) for r in got.collect()] == [("u", 0, 11.0, 2.75, 1, 90000.0)]


def test_typing_metrics(spark):
    data = [("a", 0, 0.0), ("a", 1, 0.5), ("a", 2, None), ("a", 3, 1.0), ("a", 4, 9.0), ("a", 5, 9.1), ("b", 6, 1.0), ("c", 7, 0.0), ("c", 8, 5.0)]
    df = spark.createDataFrame(data, "k string, ord long, timestamp_precise double")
    got = {r["k"]: r for r in sessions.typing_metrics(df, ["k"], chunk_size=2).collect()}
    assert (got["a"]["sample_size"], got["a"]["kps"], got["a"]["wpm"], got["a"]["avg_flight_time"]) == (2, 5.0, 60.0, 0.3)
    assert got["a"]["flight_time_sd"] == 0.2828 and got["b"]["note"] == "Insufficient data" and got["b"]["kps"] == 0.0
    assert got["c"]["note"] is None and got["c"]["kps"] == 0.0


def test_merge_repeats_is_null_safe(spark):
    data = [("u", 0, None, 1.0), ("u", 1, None, 2.0), ("u", 2, "x", 3.0), ("u", 3, None, 4.0)]
    df = spark.createDataFrame(data, "user string, ord long, app string, duration double")
    got = sessions.merge_repeats(df, ["user"], ["app"], ["ord"], ordinal_chunk("ord", 2))
    assert sorted((r["id"], r["ord"], r["duration"]) for r in got.collect()) == [(0, 0, 3.0), (1, 2, 3.0), (2, 3, 4.0)]


def keys(spark, presses):
    data = [("u", i, "key_press", "down", k, m) for i, (k, m) in enumerate(presses)]
    return spark.createDataFrame(data, "user string, ord long, event_type string, action string, key_char string, modifiers map<string,boolean>")


def test_typed_text_rules_for_any_chunk(spark):
    shift, ctrl, cmd = {"shift": True}, {"ctrl": True}, {"cmd": True, "shift": True}
    presses = [("backspace", {}), ("a", shift), ("a", {"shift": True, "caps_lock": True}), ("1", shift), ("space", {}), ("b", {}), ("c", ctrl),
               ("space", cmd), ("s", cmd), ("enter", {}), ("up", {}), (None, {}), (" ", {}), ("d", {}), ("backspace", {}),
               ("tab", {}), ("x", {}), ("y", {}), ("space", {}), ("backspace", ctrl), ("shift", shift)]
    for size in (1, 2, 3, 1000, None):
        got = typed_text(keys(spark, presses), ["user"], chunk_size=size).first()["text"]
        assert got == "Aa! b<ctrl+c><cmd+shift+s>\n<up><None>\t"


def test_word_deletion_crosses_chunks(spark):
    presses = [(c, {}) for c in "ab"] + [("space", {})] + [(c, {}) for c in "cdef"] + [("space", {}), ("backspace", {"ctrl": True}), ("backspace", {})]
    for size in range(1, 9):
        assert typed_text(keys(spark, presses), ["user"], chunk_size=size).first()["text"] == "ab"


def test_pairs_history_and_budget(spark):
    df = spark.createDataFrame([("u", i, [5, 5, 90, 5, 5, 5, 5, 5, 5][i]) for i in range(9)], "user string, idx long, tok long")
    got = pairs.pair_records(df, ["user"], "idx", ["idx"], history=3, chunk_size=4)
    assert [(r["pair_idx"], r["first"][0], r["second"][0], [h[0] for h in r["history"]]) for r in got.orderBy("pair_idx").collect()] == [
        (0, 0, 1, []), (1, 2, 3, [0, 1]), (2, 4, 5, [1, 2, 3]), (3, 6, 7, [3, 4, 5])]
    kept = pairs.pairs_within_budget(df, ["user"], "idx", "tok", history=2, budget=20, chunk_pairs=1)
    assert [(r["pair_idx"], r["history_ids"]) for r in kept.orderBy("pair_idx").collect()] == [(0, []), (2, [0, 1]), (3, [4, 5])]


def test_batches_carry_text_and_range(spark):
    df = spark.createDataFrame([("u", 0, "s0", "t0", 1, 2), ("u", 4, "s4", "", None, None), ("u", 2, "", "t2", 5, 6)],
                               "user string, pair_idx long, summary string, transcription string, start int, end int")
    got = pairs.batch_observations(df, ["user"], 2).orderBy("batch_id").collect()
    assert [tuple(r)[1:] for r in got] == [
        (0, [0, 2], "--- Pair 0 ---\n\n## Summary\ns0\n\n## Transcription\nt0\n\n\n--- Pair 2 ---\n\n## Transcription\nt2\n\n", 1, 6, 0),
        (1, [4], "--- Pair 4 ---\n\n## Summary\ns4\n\n", None, None, 1)]


def test_frames_index_and_stable_states(spark):
    rec = spark.createDataFrame([("u", 0, 10, 5.0, "2025-01-01 00:00:00", "a.mp4"), ("u", 1, 20, 5.0, "2025-01-01 01:00:00", "b.mp4")],
                                "user string, ord long, frames_written long, duration double, start_time string, video_source string")
    seg = segment_bounds(rec, ["user"], "ord", "frames_written", "duration", chunk_size=1).withColumn("start_time", F.to_timestamp("start_time"))
    files = spark.createDataFrame([("u", "frame_0_idx_3.jpg"), ("u", "Frame_1_IDX_13.JPG"), ("u", "frame_2_idx_31.jpg"), ("u", "x.jpg")], "user string, filename string")
    got = {r["frame_id"]: r for r in frames_index(files, seg, ["user"]).collect()}
    assert len(got) == 3 and got[0]["timestamp_iso"] == "2025-01-01T00:00:01.000000" and got[1]["video_source"] == "b.mp4"
    assert got[1]["video_offset_sec"] == 0.5 and got[2]["video_source"] is None
    sig = [0, 0, 0, 90, 90, 90, 0, 90, 90, 0, 0, 0]
    fr = spark.createDataFrame([("u", i + 1, 2.0, [s] * 4) for i, s in enumerate(sig)], "user string, seq long, fps double, sig array<int>")
    for size in (1, 4, 100, None):
        assert rows(stable_frames(fr, ["user"], chunk_size=size)) == [("u", 0, 1), ("u", 1, 4), ("u", 2, 10)]
