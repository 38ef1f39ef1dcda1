import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrace.operators import evaluate, runs
from daytrace.operators.infer import lexical_score

SCHEMA = "user string, modality string, id long, text string, vec array<float>, t double"


def unit(v):
    return (np.asarray(v) / np.linalg.norm(v)).astype(np.float32).tolist()


def made(seed=3, d=4):
    rng = np.random.default_rng(seed)
    pool = [unit(rng.normal(size=d)) for _ in range(14)]
    cand, refs, n = [], [], itertools.count(1)
    for user, many in (("a", 40), ("b", 25), (None, 12)):
        for _ in range(many):
            modality = ["ax", "metadata", "ocr"][rng.integers(3)]
            v = pool[rng.integers(14)] if rng.random() < 0.5 else unit(rng.normal(size=d))
            i = next(n)
            cand.append((user, modality, i, f"said w{i % 7} w{i % 5}", v, float(i)))
        for _ in range(many // 2):
            v = pool[rng.integers(14)] if rng.random() < 0.5 else unit(rng.normal(size=d))
            i = next(n)
            refs.append((user, "gold", i, f"Said W{i % 7} w{i % 3}", v, float(i)))
    cand.append(("only candidates", "ax", 900, "x", pool[0], 1.0))
    refs.append(("only references", "gold", 901, "x", pool[0], 1.0))
    return cand, refs


def plain(c, r, threshold, low, high, judge):
    """the metrics of one run from the whole matrix"""
    x, y = np.array([v[4] for v in c], float), np.array([v[4] for v in r], float)
    s = x @ y.T
    ramp = lambda m: np.clip((m - low) / (high - low), 0, 1)
    left, right, matched = set(), set(), 0
    for _, i, j in sorted(((s[i, j], c[i][2], r[j][2]) for i in range(len(c)) for j in range(len(r)) if s[i, j] >= threshold), reverse=True):
        if i not in left and j not in right:
            left.add(i), right.add(j)
            matched += 1
    z = np.vstack([x, y])
    mc, mr = ramp(z @ x.T), ramp(z @ y.T)
    w = 1 / np.maximum(mc.sum(1) + mr.sum(1), 1e-9)
    a, b = mc.max(1), mr.max(1)
    inter, union = (w * np.minimum(a, b)).sum(), (w * np.maximum(a, b)).sum()
    covered, supported = int((s.max(0) >= judge).sum()), int((s.max(1) >= judge).sum())
    tc, tr = {v[3].lower() for v in c}, {v[3].lower() for v in r}
    whole = x.sum(0) @ y.sum(0) / np.linalg.norm(x.sum(0)) / np.linalg.norm(y.sum(0))
    return {
        "source_to_reference_best_mean": s.max(1).mean(), "reference_to_source_best_mean": s.max(0).mean(),
        "semantic_jaccard": matched / (len(c) + len(r) - matched), "soft_jaccard": inter / union if union else 0,
        "soft_precision": inter / (w * a).sum(), "soft_recall": inter / (w * b).sum(), "soft_source_regions": (w * a).sum(),
        "covered_count": covered, "supported_count": supported, "profile_jaccard": round(len(tc & tr) / len(tc | tr), 4),
        "profile_semantic_similarity": round(whole, 4), "judge_pairs_total": len(c) * len(r),
    }


@pytest.mark.parametrize("block_rows", [2048, 5])
def test_runs_equal_whole_matrices(spark, block_rows):
    cand, refs = made()
    c, r = spark.createDataFrame(cand, SCHEMA), spark.createDataFrame(refs, SCHEMA)
    users = spark.createDataFrame([("a",), ("b",), (None,), ("only candidates",), ("only references",), ("nobody",)], "user string")
    subsets = ["ax", "ocr+ax", "ax+metadata+ocr", "screen"]
    arms = {"none": {}, "time_window_gate": {"threshold": 0.9, "window": 30}}
    got = {(x.user, x.mods, x.arm): x for x in runs.evaluate_subsets(c, r, users, subsets, arms, ["user"], threshold=0.7, low=0.5, high=0.9, judge_threshold=0.8, block_rows=block_rows).collect()}
    assert len(got) == 6 * 4 * 2
    for (user, mods, arm), row in got.items():
        own = [v for v in cand if v[0] == user and v[1] in mods.split("+")]
        ref = [v for v in refs if v[0] == user]
        assert (row.candidate_count, row.ideal_count) == (len(own), len(ref))
        assert [row[f"count_{m}"] for m in ("ax", "metadata", "ocr", "screen")] == [sum(v[1] == m for v in own) for m in ("ax", "metadata", "ocr", "screen")]
        assert row.status == ("missing_ideal" if not ref else "ok" if own else "empty_candidate")
        if row.status != "ok":
            assert row.soft_f1 is None and row.profile_interpretation is None
            continue
        if arm != "none":
            kept = []
            for v in sorted(own, key=lambda v: (v[5], v[2])):
                if not any(abs(k[5] - v[5]) <= 30 and np.dot(np.array(k[4], float), np.array(v[4], float)) >= 0.9 for k in kept):
                    kept.append(v)
            own = kept
        assert row.eval_count == len(own) and row.merge_absorbed == row.candidate_count - len(own)
        for name, value in plain(own, ref, 0.7, 0.5, 0.9, 0.8).items():
            assert row[name] == pytest.approx(value, abs=1e-4 if name.startswith("profile") else 1e-6), (user, mods, arm, name)
        score = 0.5 * row.profile_semantic_similarity + 0.3 * row.semantic_jaccard + 0.2 * row.symmetric_best_mean
        assert row.profile_composite_score == pytest.approx(score, abs=1e-4)


def test_one_product_gives_what_the_single_operators_give(spark):
    cand, refs = made(5)
    c, r = spark.createDataFrame(cand, SCHEMA), spark.createDataFrame(refs, SCHEMA)
    table = c.select("user").distinct().select("user", F.lit("all").alias("run"), F.explode(F.array(F.lit("ax"), F.lit("metadata"), F.lit("ocr"))).alias("part"))
    got = {x.user: x for x in runs.compare_runs(c.withColumnRenamed("modality", "part"), r, table, ["user"], ["run"], 0.7, 0.5, 0.9).collect()}
    single = {x.user: x for x in evaluate.compare_sets(c, r, ["user"], 0.7, 0.5, 0.9).where("status = 'ok'").collect()}
    assert set(got) == {"a", "b", None} and {"a", "b"} <= set(single)
    for user in ("a", "b"):
        for name in runs.METRICS:
            assert got[user][name] == pytest.approx(single[user][name], abs=1e-9), name


@pytest.mark.parametrize("k", [1, 3, 100])
def test_shortlisted_texts_are_scored(spark, k):
    cand, refs = made(7)
    cand = [v for v in cand if v[0] == "a"]
    refs = [v for v in refs if v[0] == "a"]
    c, r = spark.createDataFrame(cand, SCHEMA), spark.createDataFrame(refs, SCHEMA)
    table = spark.createDataFrame([("a", "all", m) for m in ("ax", "metadata", "ocr")], "user string, run string, part string")
    # copies share their first row's text, so each vector has one text here
    row = runs.compare_runs(c.withColumnRenamed("modality", "part").withColumn("text", F.concat_ws(" ", F.lit("said"), F.round(F.col("vec")[0], 1).cast("string"))),
                            r.withColumn("text", F.concat_ws(" ", F.lit("said"), F.round(F.col("vec")[0], 1).cast("string"))), table, ["user"], ["run"],
                            shortlist_k=k, scorer=lexical_score, judge_threshold=0.9).first()
    x, y = np.array([v[4] for v in cand], float), np.array([v[4] for v in refs], float)
    s = x @ y.T
    word = lambda v: str(float(np.round(np.float32(v[4][0]), 1)))
    listed = np.zeros(s.shape, bool)
    for a in range(len(cand)):
        cut = sorted(s[a])[::-1][: k][-1]
        listed[a] |= s[a] >= cut - 1e-12
    for b in range(len(refs)):
        cut = sorted(s[:, b])[::-1][: k][-1]
        listed[:, b] |= s[:, b] >= cut - 1e-12
    assert row.judge_pairs_scored == listed.sum() and row.judge_pairs_total == s.size and row.judge_shortlist_k == k
    assert row.covered_count <= len(refs) and row.supported_count <= len(cand) and word(cand[0])


def test_a_scorer_needs_a_shortlist(spark):
    with pytest.raises(ValueError):
        runs.compare_runs(None, None, None, ["user"], ["run"], scorer=lexical_score)


def test_baselines_and_folders_of_every_status(spark):
    rng = np.random.default_rng(4)
    said = [(u, m, i * 10 + k, f"t{k % 4}", unit(rng.normal(size=4))) for i, (u, m) in enumerate([("a", "gpt"), ("a", "q1"), ("a", "q2"), ("b", "q1"), ("c", "gpt")]) for k in range(6)]
    statements = spark.createDataFrame(said, "user string, model string, id long, text string, vec array<float>")
    users = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "user string")
    baselines = spark.createDataFrame([("a", "gpt", "f"), ("c", "gpt", "f")], "user string, source_model string, source_file string")
    folders = spark.createDataFrame([("a", "q1", "ax", "f"), ("a", "q2", "ocr", "f"), ("a", "q3", "ocr", None), ("a", "q4", "ax", "f"), ("b", "q1", "ax", "f")], "user string, reference_model string, mode string, reference_file string")
    got = {(r.user, r.reference_model): r for r in runs.compare_with_baseline(users, baselines, folders, statements, ["user"], threshold=0.5, low=0.2, high=0.8).collect()}
    assert {k: (r.status, r.source_count, r.reference_count) for k, r in got.items()} == {
        ("a", "q1"): ("ok", 6, 6), ("a", "q2"): ("ok", 6, 6), ("a", "q3"): ("missing_input", 0, 0), ("a", "q4"): ("ok", 6, 0),
        ("b", "q1"): ("missing_input", 0, 0), ("c", None): ("missing_qwen_input", 0, 0), ("d", None): ("missing_qwen_input", 0, 0)}
    for model in ("q1", "q2"):
        source, ref = [[(u, m, i, t, v) for u, m, i, t, v in said if u == "a" and m == name] for name in ("gpt", model)]
        for name, value in plain(source, ref, 0.5, 0.2, 0.8, 0.5).items():
            if name in runs.METRICS or name in runs.PROFILE:
                assert got["a", model][name] == pytest.approx(value, abs=1e-4 if name.startswith("profile") else 1e-6), name
    assert got["a", "q4"].soft_f1 == 0.0 and got["d", None].soft_f1 is None
