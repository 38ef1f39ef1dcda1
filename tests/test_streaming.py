import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrace.operators import merge as mg
from daytrace.operators import sessions
from daytrace.operators.frames import stable_frames
from daytrace.streaming import stateful as st


def play(spark, batches, schema, build, name, mode="append"):
    """Write each batch as one file, replay them in order, and return the memory sink's rows."""
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


SCHEMA = "user string, s long, event_type string"


def timed(d):
    """an hour after the epoch and later: the watermark begins at the epoch"""
    return d.withColumn("ts", F.timestamp_seconds(F.col("s") + 3600))


def batch_sessions(spark, data):
    df = timed(spark.createDataFrame(data, SCHEMA)).withColumn("ord", F.col("s"))
    ses = sessions.build_sessions(df.where("event_type = 'app'").select("user", "ts", "ord"), ["user"])
    return ses, sessions.assign_events(ses, df.where("event_type = 'key'").select("user", "ts", "ord", "event_type"), ["user"])


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_sessions_equal_batch(spark, shuffled):
    """In order, or in any order inside ten minutes, over several micro-batches: the same sessions and events as in batch."""
    rng = np.random.default_rng(6)
    data = [("u", i * 60, "app" if i % 4 == 0 else "key") for i in range(40)] + [("v", i * 60 + 5, "app" if i % 7 == 0 else "key") for i in range(40)]
    arrival = {r: r[1] + (rng.integers(0, 590) if shuffled else 0) for r in data}
    data.sort(key=lambda r: arrival[r])
    # the last two rows move the watermark past everything
    parts = [data[i : i + 9] for i in range(0, len(data), 9)] + [[("z", 100_000, "key")], [("z", 200_000, "key")]]
    got = play(spark, parts, SCHEMA, lambda d: st.stream_sessions(timed(d)), f"s1_{shuffled}")
    ses, asg = batch_sessions(spark, data)
    want = sessions.activity_counts(ses, asg, ["user"], [])
    key = lambda d: sorted((r["user"], r["session_id"], r["n_events"]) for r in d.collect())
    assert key(got) == key(want)
    placed = play(spark, parts, SCHEMA, lambda d: st.stream_assigned(timed(d)), f"s5_{shuffled}")
    whole = {(r["user"], r["session_id"]) for r in ses.collect()}
    mine = sorted((r["user"], r["session_id"], r["us"] // 1_000_000) for r in placed.collect() if (r["user"], r["session_id"]) in whole)
    assert mine == sorted((r["user"], r["session_id"], int(r["ts"].timestamp())) for r in asg.collect())


def test_rows_behind_the_watermark_are_lost_and_no_others(spark):
    batches = [[("u", 0, "app"), ("u", 2_000, "app")], [("u", 2_001, "key")], [("u", 100, "key"), ("u", 1_900, "key"), ("u", 3_000, "app")], [("z", 90_000, "key")], [("z", 99_000, "key")]]
    got = play(spark, batches, SCHEMA, lambda d: st.stream_sessions(timed(d)), "s6")
    assert sorted((r["session_id"], r["n_events"]) for r in got.collect()) == [(0, 1), (1, 1)]


def test_stream_gate_equals_batch(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4, 5))
    data = []
    for i in range(40):
        v = base[i % 4] + rng.normal(scale=0.3, size=5)
        data.append(("u" if i % 3 else "v", i, float(i // 3), [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)]))
    schema = "user string, id long, t double, vec array<float>"
    got = play(spark, [data[:13], data[13:30], data[30:]], schema, lambda d: st.stream_novelty(d, threshold=0.85, window=4.0), "s2")
    want = mg.novelty_gate(spark.createDataFrame(data, schema).withColumn("text", F.lit("")), ["user"], 0.85, 4.0)
    assert sorted((r["id"], r["kept"]) for r in got.collect()) == sorted((r["id"], r["kept"]) for r in want.collect())


def test_stream_gate_out_of_order_equals_batch(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 5))
    data = []
    for i in range(40):
        v = base[i % 4] + rng.normal(scale=0.3, size=5)
        data.append(("u" if i % 3 else "v", i, float(i // 3), [float(x) for x in (v / np.linalg.norm(v)).astype(np.float32)]))
    mixed = sorted(data, key=lambda r: r[2] + rng.integers(0, 6))
    schema = "user string, id long, t double, vec array<float>"
    far = [("z", 900, 1e5, data[0][3])], [("z", 901, 2e5, data[0][3])]
    got = play(spark, [mixed[:13], mixed[13:30], mixed[30:], *far], schema, lambda d: st.stream_novelty(d.withColumn("ts", F.timestamp_seconds(F.col("t") + 3600)), threshold=0.85, window=4.0, ts="ts", delay="10 seconds"), "s7")
    want = mg.novelty_gate(spark.createDataFrame(data, schema).withColumn("text", F.lit("")), ["user"], 0.85, 4.0)
    assert sorted((r["id"], r["kept"]) for r in got.collect() if r["id"] < 900) == sorted((r["id"], r["kept"]) for r in want.collect())


def test_stream_frames_equal_batch(spark):
    sig = [0, 0, 0, 90, 90, 90, 0, 90, 90, 0, 0, 0, 50, 50, 50, 50]
    data = [("u", i + 1, 2.0, [s] * 4) for i, s in enumerate(sig)]
    schema = "user string, seq long, fps double, sig array<int>"
    got = play(spark, [data[:5], data[5:11], data[11:]], schema, st.stream_stable_frames, "s3")
    want = stable_frames(spark.createDataFrame(data, schema), ["user"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_windows_drop_late_rows(spark):
    schema = "user string, s long, event_type string"
    batches = [[("u", 10, "a"), ("u", 70, "a")], [("u", 5000, "a")], [("u", 5001, "a")], [("u", 20, "a")], [("u", 9000, "a")]]
    got = play(spark, batches, schema, lambda d: st.stream_windows(d.withColumn("ts", F.timestamp_seconds("s")), "user", 60), "s4")
    assert sorted((r["start_us"], r["n"]) for r in got.collect())[:2] == [(0, 1), (60_000_000, 1)]
