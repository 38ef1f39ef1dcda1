import json
import re

import pytest
from pyspark.sql import functions as F

from daytrace.operators import observe as ob
from daytrace.operators import profiles as pf
from daytrace.operators.pairs import pair_ranges


def records(spark, users=("a", "b", None), n=25):
    rows = [(u, i, i, f"{u} does {i}", 3 + i % 5) for u in users for i in range(n)] + [("lone", 0, 0, "x", 1)]
    return spark.createDataFrame(rows, "user string, idx long, id long, body string, size int")


def shouting():
    """a client that answers in capitals; made here, so that workers need not import this module"""

    def client():
        return lambda prompts: [p.upper() for p in prompts]

    return client


def run(spark, path, client, rows=None, **options):
    rows = records(spark) if rows is None else rows
    app = rows.select("user", F.col("idx").alias("ord"), (F.col("idx") * 10).alias("ts"))
    body = lambda p: p["body"]
    layer, failed = ob.observe(
        rows, ["user"], "idx", ["id", "body"], path, client, lambda a, b: F.concat(F.lit("pair: "), body(a), F.lit(" | "), body(b)),
        lambda h, a, b: F.concat(F.lit("sum: "), F.array_join(F.transform(h, body), ";"), F.lit(" > "), body(b)),
        history=3, ranges=lambda d: pair_ranges(d, app.where("user is not null"), ["user"], "metadata"), **{"calls": 1, "chunks": 8, "wave": 3, **options})
    return sorted((tuple(r) for r in layer.collect()), key=str), sorted((tuple(r) for r in failed.collect()), key=str)


def expected(n=25, users=("a", "b", None)):
    out = []
    for u in users:
        for p in range(n // 2):
            a, b = 2 * p, 2 * p + 1
            h = list(range(max(0, a - 3), a))
            said = lambda i: f"{u} does {i}".upper() if u else "NONE DOES " + str(i)
            times = (a * 10, min(b + 1, n - 1) * 10) if u else (None, None)
            out.append((u, p, a, b, h, f"PAIR: {said(a)} | {said(b)}", f"SUM: {';'.join(said(i) for i in h)} > {said(b)}", *times))
    return sorted(out, key=str)


def test_failures_and_restarts_end_in_the_same_layer(spark, tmp_path):
    def picky():
        def answer(prompts):
            if any(re.search(r"sum: .*does (7|19)$", p) for p in prompts):
                raise RuntimeError("too hard")
            return [p.upper() for p in prompts]

        return answer

    clean, none = run(spark, f"{tmp_path}/clean", shouting())
    assert clean == expected() and none == []
    first, failed = run(spark, f"{tmp_path}/ledger", picky)
    hard = {(u, p) for u in ("a", "b", None) for p in (3, 9)}
    assert {r[:2] for r in failed} == hard and all(r[2:] == ("too hard", 1) for r in failed)
    assert first == [r for r in clean if r[:2] not in hard]
    asked_again, failed = run(spark, f"{tmp_path}/ledger", picky)
    assert asked_again == first and all(r[3] == 2 for r in failed)
    assert run(spark, f"{tmp_path}/ledger", shouting()) == (clean, [])
    ledger = ob.read_ledger(spark, f"{tmp_path}/ledger")
    assert ledger.count() == len(clean) + 2 * len(hard)  # nothing that was answered is asked again
    planned = ledger.select("user", "pair_idx").distinct()
    status = ob.chunk_status(planned, ledger, ["user", "pair_idx"], 8).agg(F.sum("planned"), F.sum("finished"), F.sum("failed")).first()
    assert tuple(status) == (len(clean), len(clean), 0)


def test_a_lost_job_keeps_its_finished_waves(spark, tmp_path):
    planned = spark.range(200).select(F.col("id").alias("k"))
    started = []

    def work(todo):
        started.append(1)
        if len(started) == 3:
            raise KeyboardInterrupt
        return todo.withColumn("answer", F.col("k") * 2).withColumn("error", F.lit(None).cast("string"))

    path = f"{tmp_path}/ledger"
    with pytest.raises(KeyboardInterrupt):
        ob.run_ledger(planned, ["k"], path, work, chunks=8, wave=2)
    kept = ob.read_ledger(spark, path)
    held = kept.count()
    assert 0 < held < 200 and kept.select("chunk").distinct().count() == 4
    done = ob.run_ledger(planned, ["k"], path, work, chunks=8, wave=2)
    assert done.count() == 200 and done.where("attempt = 1").count() == held and done.where("answer = 2 * k").count() == 200
    n = len(started)
    ob.run_ledger(planned, ["k"], path, work, chunks=8, wave=2)
    assert len(started) == n  # nothing to do, nothing is started


def test_pairs_over_budget_are_left_out_of_history(spark, tmp_path):
    rows = records(spark, ("a",), 12).withColumn("size", F.when(F.col("idx").isin(4, 5), 100).otherwise(10))
    got = ob.observation_pairs(rows, ["user"], "idx", ["id", "body"], 2, "size", 60)
    found = sorted((r.pair_idx, r.first.id, r.second.id, [h.id for h in r.history]) for r in got.collect())
    assert found == [(0, 0, 1, []), (1, 2, 3, [0, 1]), (3, 6, 7, [2, 3]), (4, 8, 9, [6, 7]), (5, 10, 11, [8, 9])]


def test_nothing_to_observe(spark, tmp_path):
    assert run(spark, f"{tmp_path}/x", shouting(), records(spark, (), 0)) == ([], [])


LINE = re.compile(r"- id: (\d+)\n  proposition: \"(.*?)\"\n  confidence: (\w+)\n  decay: (\w+)\n", re.S)


def counting():
    """partial profiles name the confidences met and count words; merged ones unite and add"""

    def client():
        def one(prompt):
            if "poison" in prompt:
                raise RuntimeError("no")
            if "garbage" in prompt:
                return "[1]"
            if prompt.startswith("MERGE"):
                seen = [json.loads(p) for p in prompt.split("\n")[1:]]
                assert 2 <= len(seen)
                skills = sorted({s for p in seen for s in p["static_profile"]["background_knowledge_skills"]["skills"]})
                words = sum(int(p["dynamic_profile"]["behaviors"]["recent_tasks"][0]) for p in seen)
            else:
                found = LINE.findall(prompt)
                assert sum(len(t.split(" ")) for _, t, _, _ in found[:-1]) < 40
                skills = sorted({c for _, _, c, _ in found})
                words = sum(len(t.split(" ")) for _, t, _, _ in found)
            return json.dumps({"static_profile": {"background_knowledge_skills": {"skills": skills}, "demographics": {"age_range": "20-30"}}, "dynamic_profile": {"behaviors": {"recent_tasks": [str(words)]}}})

        return lambda prompts: [one(p) for p in prompts]

    return client


def profiles(spark, rows, tokens=40):
    df = spark.createDataFrame(rows, "user string, n long, text string, confidence int, decay int")
    out = pf.generate_profiles(df, ["user"], "n", counting(), lambda lines: F.concat(F.lit("FIRST\n"), lines), lambda ps: F.concat(F.lit("MERGE\n"), F.array_join(ps, "\n")), tokens)
    return {r.user: r for r in out.collect()}


def test_profiles_grow_out_of_bounded_prompts(spark):
    rows = [(u, i, " ".join(["w"] * (1 + i % 9)), i % 11, 1) for u, n in (("many", 300), ("few", 3), (None, 40)) for i in range(n)]
    rows += [("long", 0, " ".join(["v"] * 1000), 4, 2), ("odd", 0, None, None, None), ("odd", 1, "", 3, 3)]
    got = profiles(spark, rows)
    assert set(got) == {"many", "few", None, "long", "odd"}
    for user, row in got.items():
        own = [r for r in rows if r[0] == user]
        assert row.error is None and row.json is not None
        words = sum(len((t or "").split(" ")) for _, _, t, _, _ in own)
        assert int(row.profile.dynamic_profile.behaviors.recent_tasks[0]) == words
        assert row.profile.static_profile.background_knowledge_skills.skills == sorted({str(c) if c is not None else "null" for *_, c, _ in own})
        assert row.profile.static_profile.demographics.age_range == "20-30" and row.profile.static_profile.goals_and_needs is None
    assert got["few"].levels == 0 and got["few"].parts == 1 and got["many"].parts > 30 and got["many"].levels >= 2 and got["long"].parts == 25


def test_a_failing_part_fails_its_user_only(spark):
    rows = [(u, i, f"t{i}" + (f" {bad}" if i == 70 else ""), 1, 1) for u, bad in (("a", "poison"), ("b", "garbage"), ("c", "")) for i in range(100)]
    got = profiles(spark, rows)
    assert (got["a"].error, got["b"].error, got["c"].error) == ("no", "answer is no JSON object", None)
    assert got["a"].json is None and got["c"].profile is not None and len(got) == 3


def test_no_statements_no_profiles(spark):
    assert profiles(spark, []) == {}
