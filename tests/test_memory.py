import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrace.operators import memory
from daytrace.operators import merge as mg

WORDS = [f"w{k}" for k in range(12)]


def vector(text):
    """one place a word; counts at unit length"""
    v = np.array([text.split().count(w) for w in WORDS], float)
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32)


def embed(text):
    words = F.array(*[F.lit(w) for w in WORDS])
    count = F.transform(words, lambda w: F.size(F.filter(F.split(text, " "), lambda x: x == w)).cast("double"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(count, lambda x: F.when(norm(count) > 0, x / norm(count)).otherwise(0.0).cast("float"))


def answered(texts):
    """the later half of the older text, then the newer one: entries drift"""
    if "w11" in texts[-1].split():
        raise RuntimeError("engine down")
    older, newer = texts[0].split(), texts[-1].split()
    return " ".join((older[len(older) // 2 :] + newer)[-6:]), memory.MERGE_TYPES[len(newer) % 4]


def client_of():
    def client():
        import json as js

        def one(prompt):
            texts = js.loads(prompt.partition("\n")[2])
            if "w11" in texts[-1].split():
                raise RuntimeError("engine down")
            older, newer = texts[0].split(), texts[-1].split()
            kinds = ["generalize", "refine", "supersede", "contradict"]
            return js.dumps({"merged_proposition": " ".join((older[len(older) // 2 :] + newer)[-6:]), "merge_type": kinds[len(newer) % 4]})

        return lambda prompts: [one(p) for p in prompts]

    return client


def sequential(texts, theta):
    store, into = [], []
    for k, text in enumerate(texts):
        v = vector(text).astype(float)
        sims = [float(np.dot(e["vec"], v)) for e in store]
        best = int(np.argmax(sims)) if sims else None
        if best is None or sims[best] < theta:
            store.append({"pos": k, "text": text, "vec": v, "type": "refine", "versions": 1, "failures": 0})
            into.append(None)
            continue
        e = store[best]
        into.append(e["pos"])
        try:
            e["text"], e["type"] = answered([e["text"], text])
            e["vec"] = vector(e["text"]).astype(float)
            e["versions"] += 1
        except RuntimeError:
            e["failures"] += 1
    return store, into


@pytest.mark.parametrize("block_rows,seed,theta", [(2048, 1, 0.6), (7, 2, 0.75)])
def test_the_store_equals_a_pass_one_by_one(spark, block_rows, seed, theta):
    rng = random.Random(seed)
    said = {u: [" ".join(rng.choices(WORDS, k=rng.choice([2, 3, 4]))) for _ in range(n)] for u, n in (("a", 40), (None, 15), ("lone", 1))}
    rows = [(u, k, t, vector(t).tolist(), "x") for u, ts in said.items() for k, t in enumerate(ts)]
    mains = spark.createDataFrame(rows, "user string, pos long, text string, vec array<float>, entry_note string")
    rounds = []
    guess = mains.select("user", "pos", F.lit(None).cast("long").alias("into"))
    got = {(r.user, r.pos): r for r in memory.roll_up(mains, guess, ["user"], theta, client_of(), embed, block_rows, rounds).collect()}
    assert rounds[-1] == 0 and len(got) == len(rows)
    for user, texts in said.items():
        store, into = sequential(texts, theta)
        assert [got[user, k].into for k in range(len(texts))] == into
        for e in store:
            r = got[user, e["pos"]]
            assert (r.kept, r.text, r.merge_type, r.versions, r.failures) == (True, e["text"], e["type"], e["versions"], e["failures"])
    assert any(e["failures"] for ts in said.values() for e in sequential(ts, theta)[0]) or seed == 2


def test_windows_and_store_write_with_types(spark):
    texts = ["w1 w2", "w1 w2", "w3", "w1 w2 w2", "w4 w5", "w3 w3", "w1 w2", "w11 w11"]
    rows = [("u", k, float(k), t, vector(t).tolist()) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "user string, id long, t double, text string, vec array<float>")
    out = {r.pos: r for r in mg.moving_window(df, ["user"], 3, 0.9, client=client_of(), embed=embed).collect()}
    # window 0: ids 0, 1 become one text; window 1: 3, 4, 5; window 2: 6, 7
    mains = [answered(["w1 w2", "w1 w2"])[0], "w3", "w1 w2 w2", "w4 w5", "w3 w3", "w1 w2", "w11 w11"]
    store, into = sequential(mains, 0.9)
    assert [out[k].into for k in range(len(mains))] == into
    assert {k: out[k].text for k in out if out[k].kept} == {e["pos"]: e["text"] for e in store}
    assert {out[k].merge_type for k in out if out[k].kept} <= set(memory.MERGE_TYPES)
    with pytest.raises(ValueError):
        mg.moving_window(df, ["user"], 3, 0.9, client=client_of())


def test_gate_writes_what_it_took_in(spark):
    texts = ["w1 w2", "w1 w2 w2", "w3 w4", "w1 w2", "w11", "w11"]
    rows = [("u", k, float(k), t, vector(t).tolist()) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "user string, id long, t double, text string, vec array<float>")
    gated = mg.novelty_gate(df.select("user", "id", "t", "text", "vec"), ["user"], 0.8, 10)
    got = {r.id: (r.text, r.merge_type, r.size) for r in mg.gate_reduce(gated, ["user"], memory.merge_writer(client_of())).collect()}
    assert set(got) == {0, 2, 4} and got[2] == ("w3 w4", "refine", 1) and got[4] == ("w11", None, 2)
    assert got[0][2] == 3 and got[0][1] in memory.MERGE_TYPES and got[0][0] != "w1 w2"
    named = mg.run_arm(df, ["user"], "time_window_gate", threshold=0.8, window=10, write=memory.merge_writer(client_of()))
    assert {r.id for r in named.collect()} == {0, 2, 4}


def test_answers_off_the_schema_are_errors(spark):
    for bad in ("x", "[1]", "{}", json.dumps({"merged_proposition": 3, "merge_type": "refine"}), json.dumps({"merged_proposition": "a", "merge_type": "other"}), None):
        with pytest.raises(ValueError):
            memory.read_merge(bad)
    parts = spark.createDataFrame([("u", 1, 0, ["a", "b"])], "user string, cluster long, part long, texts array<string>")
    row = memory.merge_writer(lambda: lambda ps: ["no json"] * len(ps))(parts).first()
    assert row.error == memory.WRONG and row.text is None


def encoder_of():
    words = list(WORDS)

    def encoder():
        import numpy

        def one(text):
            v = numpy.array([text.split().count(w) for w in words], float)
            n = numpy.linalg.norm(v)
            return (v / n if n else v).astype(numpy.float32)

        return lambda texts: [one(t) for t in texts]

    return encoder


def plans_since(spark, at):
    """Plans of the executions that began after the first ``at``."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(at, found.size())]


@pytest.mark.parametrize("stretch,store_rows,wide", [(1000, 1000, False), (7, 1000, False), (11, 4, True)])
def test_stretches_equal_a_pass_one_by_one(spark, stretch, store_rows, wide):
    rng = random.Random(3)
    said = {u: [" ".join(rng.choices(WORDS, k=rng.choice([2, 3, 4]))) for _ in range(n)] for u, n in (("a", 45), (None, 15), ("lone", 1), ("same", 30))}
    said["same"] = ["w1 w2"] * 29 + ["w3"]
    rows = [(u, k, t, vector(t).tolist(), "x") for u, ts in said.items() for k, t in enumerate(ts)]
    mains = spark.createDataFrame(rows, "user string, pos long, text string, vec array<float>, entry_note string")
    guess, rounds = mains.select("user", "pos", F.lit(None).cast("long").alias("into")), []
    out = memory.roll_up(mains, guess, ["user"], 0.7, client_of(), embed, 7, rounds, encode=encoder_of(), stretch=stretch, store_rows=store_rows)
    got = {(r.user, r.pos): r for r in out.collect()}
    assert bool(rounds) == wide and len(got) == len(rows) == out.count()
    for user, texts in said.items():
        store, into = sequential(texts, 0.7)
        assert [got[user, k].into for k in range(len(texts))] == into
        assert [got[user, k].kept for k in range(len(texts))] == [i is None for i in into]
        for e in store:
            r = got[user, e["pos"]]
            assert (r.text, r.merge_type, r.versions, r.failures, r.entry_note) == (e["text"], e["type"], e["versions"], e["failures"], "x")
    assert any(e["failures"] for ts in said.values() for e in sequential(ts, 0.7)[0])
    none = memory.roll_up(mains.where("false"), guess.where("false"), ["user"], 0.7, client_of(), embed, encode=encoder_of())
    assert none.columns == out.columns and none.count() == 0


def test_rounds_broadcast_no_table(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=3)) for _ in range(20)]
    mains = spark.createDataFrame([("a", k, t, vector(t).tolist()) for k, t in enumerate(texts)], "user string, pos long, text string, vec array<float>")
    guess, before = mains.select("user", "pos", F.lit(None).cast("long").alias("into")), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    at, rounds = len(plans_since(spark, 0)), []
    out = memory.roll_up(mains, guess, ["user"], 0.6, client_of(), embed, 7, rounds)
    assert out.count() == 20 and len(rounds) > 1
    plans = plans_since(spark, at)
    assert len(plans) > len(rounds) and not any("BroadcastExchange" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_jobs_of_the_rewritten_store_do_not_follow_its_chains(spark, tmp_path):
    from daytrace.plans.stages import rewritten_store

    rng = random.Random(1)

    def executions(n):
        rows = [(u * 1000 + k, u, rng.randrange(100_000) / 100) for u in (1, 2) for k in range(n)]
        path = str(tmp_path / str(n))
        spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{path}/supplier.parquet")
        at = len(plans_since(spark, 0))
        assert rewritten_store(spark, path).count() == 2 * n
        return len(plans_since(spark, at))

    assert executions(40) == executions(4)
