import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from daytrace.functions import vectors as vx
from daytrace.operators import evaluate as ev
from daytrace.operators import report as rp


def sets(spark, n=40, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 4))
    out = []
    for i in range(n):
        v = base[i % 6] + rng.normal(scale=0.3, size=4)
        v = (v / np.linalg.norm(v)).astype(np.float32)
        out.append(("u", i, f"text {i % 6}", [float(x) for x in v]))
    df = spark.createDataFrame(out, "user string, id long, text string, vec array<float>")
    return df.where("id % 2 = 0"), df.where("id % 2 = 1"), out


def test_soft_coverage_against_matrices(spark):
    s, r, out = sets(spark)
    m = np.array([o[3] for o in out])
    is_s = np.array([o[1] % 2 == 0 for o in out])
    mu = np.clip((m @ m.T - 0.6) / 0.2, 0, 1)
    w = 1 / np.maximum(mu.sum(axis=1), 1e-9)
    ms, mr = mu[:, is_s].max(axis=1), mu[:, ~is_s].max(axis=1)
    got = ev.soft_coverage(s, r, ["user"], block_rows=7).first()
    j = (w * np.minimum(ms, mr)).sum() / (w * np.maximum(ms, mr)).sum()
    assert np.isclose(got["soft_jaccard"], j) and np.isclose(got["soft_f1"], 2 * j / (1 + j))
    assert 0 <= got["soft_precision"] <= 1 and np.isclose(got["soft_source_regions"], (w * ms).sum())


def test_compare_sets_gives_zeros_for_missing_sides(spark):
    s, r, _ = sets(spark)
    lone = s.withColumn("user", F.lit("lone"))
    got = {x["user"]: x for x in ev.compare_sets(s.unionByName(lone), r, ["user"]).collect()}
    assert got["u"]["status"] == "ok" and got["u"]["semantic_jaccard"] > 0
    assert got["lone"]["status"] == "missing_ideal" and got["lone"]["soft_f1"] == 0.0


def test_judge_with_shortlist_and_scorer(spark):
    s, r, out = sets(spark)
    same = lambda a, b: (a == b).cast("double")
    cover, support, total = ev.judge(s, r, ["user"], threshold=0.5, top_k=3, scorer=same, shortlist_k=5, block_rows=6)
    t = total.first()
    # i % 6 fixes parity, so a text never appears on both sides
    assert t["covered_count"] == 0 and t["f1_score"] == 0.0 and cover.count() == 20 and support.count() == 20
    _, _, t = ev.judge(s, r, ["user"], threshold=-1.0, top_k=2)
    assert t.first()["recall_rate"] == 1.0 and t.first()["precision_rate"] == 1.0


def test_top_k_then_threshold(spark):
    scored = spark.createDataFrame([("u", 1, j, sc) for j, sc in enumerate([0.9, 0.4, 0.8, 0.7])], "user string, i long, j long, score double")
    got = ev.judge_rows(scored, ["user"], "i", "j", 0.75, 3).first()
    assert got["matched_ids"] == [0, 2] and got["best_score"] == 0.9


def test_agreement_toy_cases(spark):
    data = [(1, 1), (1, 1), (0, 0), (1, 0)]
    got = ev.rater_agreement(spark.createDataFrame(data, "a int, b int"), "a", "b").first()
    po, pe = 0.75, 0.75 * 0.5 + 0.25 * 0.5
    pi = 5 / 8
    pg = 2 * pi * (1 - pi)
    assert np.isclose(got["kappa"], (po - pe) / (1 - pe)) and np.isclose(got["ac1"], (po - pg) / (1 - pg))
    same = ev.rater_agreement(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"), "a", "b").first()
    assert same["kappa"] is None and same["observed"] == 1.0


@pytest.mark.parametrize("p,level", [([0.1, 0.3, 0.2, 0.9], 0.5), ([0.6, 0.7], 0.5), ([0.1, 0.2], 0.5), ([0.1, 0.5, 0.5, 0.8], 0.5), ([0.0, 0.0, 1.0], 0.5)])
def test_crossing_is_interpolation_on_the_running_maximum(spark, p, level):
    x = [0.1 * (i + 1) for i in range(len(p))]
    df = spark.createDataFrame([("u", a, b) for a, b in zip(x, p)] + [("u", 9.0, None)], "user string, centre double, p_match double")
    want = float(np.interp(level, np.maximum.accumulate(p), x))
    assert np.isclose(ev.crossing(df, ["user"], level).first()["crossing"], want)


def test_profile_fields_keep_only_lists_of_strings(spark):
    doc = {"goals": {"short": ["Run", "Read"], "none": []}, "traits": ["calm"], "mixed": ["a", 1], "name": "x", "k.k": {"v": ["z"]}, "nested": [["q"]]}
    df = spark.createDataFrame([("p", json.dumps(doc))], "profile_id string, profile string")
    fields = ev.profile_fields(df, ["profile_id"])
    assert {r["path"]: r["items"] for r in fields.collect()} == {"goals.short": ["Run", "Read"], "traits": ["calm"], "k.k.v": ["z"]}
    assert ev.profile_text(fields, ["profile_id"]).first()["text"] == "Run Read z calm"


def test_field_similarity_and_mirror(spark):
    f = spark.createDataFrame([("p", "goals", ["A", "b"]), ("q", "goals", ["a", "c"]), ("q", "x", ["z"])], "profile_id string, path string, items array<string>")
    pr = spark.createDataFrame([("p", "q")], "a string, b string")
    sims = ev.field_similarity(f, pr)
    assert {r["path"]: (round(r["jaccard"], 4), r["weight"]) for r in sims.collect()} == {"goals": (0.3333, 0.25), "x": (0.0, 0.05)}
    score = ev.profile_scores(sims, pr.withColumn("semantic", F.lit(0.5)))
    assert score.first()["interpretation"] == "Moderate Similarity" or score.first()["composite_score"] < 0.4
    assert ev.mirrored(score, "composite_score").count() == 4


def test_normalize_handles_bad_values(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 2.0],), ([float("inf"), 0.0],), ([1e12, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(vx.normalize(F.col("v"))).collect()]
    assert np.allclose(got, [[0.6, 0.8], [0, 0], [0, 1], [0, 0], [1, 0]])


def test_report_marks_and_frontier_ties(spark):
    t = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5001), ("m", "c", 0.4), ("m", "d", 0.3), ("n", "a", 0.2)], "method string, modalities string, mean double")
    got = {(r["method"], r["modalities"]): r["mark"] for r in rp.mark_cells(t, "method").collect()}
    assert got == {("m", "a"): "best", ("m", "b"): "best", ("m", "c"): "second", ("m", "d"): None, ("n", "a"): None}
    p = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (2.0, 1.0), (2.0, 3.0), (3.0, 2.0), (0.5, 0.1)], "x double, y double")
    assert rows(rp.frontier(p)) == [(0.5, 0.1), (1.0, 1.0), (1.0, 1.0), (2.0, 3.0)]


def test_mean_ci_uses_student_t(spark):
    v = [1.0, 2.0, 4.0]
    df = spark.createDataFrame([("g", x) for x in v] + [("one", 1.0)] + [("many", float(i % 5)) for i in range(40)], "k string, v double")
    got = {r["k"]: r for r in rp.mean_ci(df, ["k"], "v").collect()}
    assert np.isclose(got["g"]["ci"], 4.303 * np.std(v, ddof=1) / np.sqrt(3)) and got["one"]["ci"] is None
    w = [float(i % 5) for i in range(40)]
    assert np.isclose(got["many"]["ci"], 1.96 * np.std(w, ddof=1) / np.sqrt(40))


def test_profile_lists_are_found_at_any_depth(spark):
    deep = '{"a": ' * 40 + '["x", "y"]' + "}" * 40
    df = spark.createDataFrame([(1, deep), (2, "{bad"), (3, None), (4, '{"k.l": ["z"], "n": [1], "e": []}')], "profile_id int, profile string")
    got = {(r["profile_id"], r["path"].count("."), tuple(r["items"])) for r in ev.profile_fields(df, ["profile_id"]).collect()}
    assert got == {(1, 39, ("x", "y")), (4, 1, ("z",))}


def test_preservation_lists_all_missing_tokens(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: i.cast("string")).alias("raw"), F.array(F.lit("1")).alias("kept"))
    r = ev.preservation(df, F.col("raw"), F.col("kept"), sample=10).first()
    assert len(r["missing"]) == 24 and len(r["missing_sample"]) == 10 and r["score"] == 4.0


def test_composite_weighs_text_matches_and_best_means(spark):
    vec = "user string, id long, vec array<double>"
    a = spark.createDataFrame([("u", 1, [1.0, 0.0]), ("u", 2, [0.0, 1.0]), ("w", 1, [1.0, 0.0])], vec)
    b = spark.createDataFrame([("u", 5, [1.0, 0.0]), ("w", 6, [0.0, 1.0])], vec)
    semantic = spark.createDataFrame([("u", 0.9), ("w", None)], "user string, semantic double")
    got = {r["user"]: r for r in ev.with_composite(ev.compare_sets(a, b, ["user"]), semantic, ["user"]).collect()}
    assert got["u"]["profile_composite_score"] == round(0.5 * 0.9 + 0.3 * 0.5 + 0.2 * 0.75, 4) and got["w"]["profile_composite_score"] == 0
    assert got["u"]["profile_interpretation"] != got["w"]["profile_interpretation"]


def test_text_cosine_of_profiles(spark):
    from collections import Counter
    from math import sqrt

    prof = {"p": {"x": ["a b", "C"], "y": ["d"]}, "q": {"x": ["a c c"], "z": ["d d"]}, "r": {"w": ["zz"]}, "s": {"x": []}}
    fields = spark.createDataFrame([(k, path, items) for k, v in prof.items() for path, items in v.items()], "profile_id string, path string, items array<string>")
    pairs = spark.createDataFrame([("p", "q"), ("p", "r"), ("p", "s"), ("q", "q")], "a string, b string")

    def cos(a, b):
        a, b = (Counter(" ".join(x).lower().split()) for x in (a, b))
        n = sqrt(sum(v * v for v in a.values())) * sqrt(sum(v * v for v in b.values()))
        return sum(a[w] * b[w] for w in a) / n if n else 0.0

    for r in ev.text_cosine(fields, pairs).collect():
        x, y = prof[r.a], prof[r.b]
        assert abs(r.semantic - cos(sum(x.values(), []), sum(y.values(), []))) < 1e-9
        paths = set(x) | set(y)
        assert abs(r.average_semantic - sum(cos(x.get(p, []), y.get(p, [])) for p in paths) / len(paths)) < 1e-9


def test_random_pairs_are_draws_with_replacement_that_anyone_can_repeat(spark):
    import hashlib

    data = [("a", i, [float(i), 1.0]) for i in range(5)] + [("b", 0, [2.0, 0.0])]
    df = spark.createDataFrame(data, "user string, ord long, vec array<double>")
    got = {(r["user"], r["draw"]): (r["i"], r["j"], r["cos"]) for r in ev.random_pairs(df, "user", 40, seed=3).collect()}
    for user, n in (("a", 5), ("b", 1)):
        for draw in range(1, 41):
            i, j = (int(hashlib.md5(f"{user}:{draw}:3:{side}".encode()).hexdigest()[:12], 16) % n for side in "ij")
            assert got[user, draw] == (i, j, i * j + 1.0 if user == "a" else 4.0)
    assert len(got) == 80 and len({v[:2] for k, v in got.items() if k[0] == "a"}) > 15
    assert ev.random_pairs(df.limit(0), "user", 40).count() == 0


def test_mean_preservation_leaves_out_records_without_a_tree(spark):
    from daytrace.operators import trees

    data = [('{"data": {"role": "window"}}', ["a", "b"], ["a"]), ('{"data": []}', [], []), ('{"data": {}}', [], []), (None, [], []), ("{}", [], []),
            ("{bad", [], []), ('{"data": [{}]}', [], ["x"])]
    df = spark.createDataFrame(data, "raw string, rt array<string>, kt array<string>")
    r = ev.preservation_mean(ev.preservation(df.where(trees.has_root(F.col("raw"))), F.col("rt"), F.col("kt"))).first()
    assert (r["n_records"], r["mean_score"], r["ok"], r["low"], r["bad"]) == (2, 75.0, 1, 1, 0)
    none = ev.preservation_mean(ev.preservation(df.limit(0), F.col("rt"), F.col("kt"))).first()
    assert (none["n_records"], none["mean_score"]) == (0, 0.0)


def shaky(df, column):
    """``df`` whose ``column`` has another last bit each time it is evaluated, as sums that arrive in another order have."""
    def noise(batches):
        import random

        for pdf in batches:
            yield pdf.assign(**{column: pdf[column] * (1 + random.SystemRandom().randint(1, 10**6) * 1e-15)})

    return df.coalesce(1).mapInPandas(noise, df.schema)


def test_values_compared_with_their_own_extremes_are_evaluated_once(spark):
    runs = shaky(spark.createDataFrame([("u", "m", f"k{i}", 0.1 + i / 100) for i in range(9)], "user string, model string, method string, f1_score double"), "f1_score")
    assert rows(rp.best_run_flag(runs).where("is_best"), "method") == [("k8",)]
    points = shaky(spark.createDataFrame([(1.0, 0.3), (2.0, 0.7), (3.0, 0.5)], "x double, y double"), "y")
    assert rows(rp.frontier(points), "x") == [(1.0,), (2.0,)]
    runs = shaky(spark.createDataFrame([("a", "u", "ok", 0.3), ("b", "u", "ok", 0.6)], "modalities string, user string, status string, f1_score double"), "f1_score")
    assert rows(rp.modality_summary(runs, "f1_score"), "modalities", "is_best", "is_weakest") == [("a", False, True), ("b", True, False)]
