import math

import numpy as np
import pytest

from daytrace.llm import whitening
from daytrace.llm.queries import QUERIES


def brute(rows, k=16, scale=64):
    kept = [(i, tuple(math.floor(scale * c) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    gap = lambda x: [n * c - s for c, s in zip(x, sums)]
    a = np.array([gap(x) for x in fit], float) / n
    e, axes = np.linalg.eigh(a.T @ a / n)
    e, axes = e[::-1][:k], axes.T[::-1][:k]
    found = {}
    for i, x in kept:
        g = gap(x)
        found.setdefault(i, []).append((n, sum(v * v for v in g), np.array(g, float) / n @ axes.T / np.sqrt(np.maximum(e, 1e-30))))
    return found, e / np.trace(a.T @ a / n)


def check(got, rows, k=16, tolerance=1e-7):
    want, explained = brute(rows, k)
    vectors = {}
    for r in got:
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-7 and r.identity_error < 1e-9
        vectors.setdefault(r.id, {}).setdefault(r.deviation, {}).setdefault(r.component, []).append((r.n, r.whitened))
    sign = None
    for i, all_of in want.items():
        for n, deviation, w in all_of:
            mine = np.array([vectors[i][deviation][c + 1][0][1] for c in range(len(w))])
            assert vectors[i][deviation][1][0][0] == n
            if sign is None or (sign == 0).any():
                sign = np.sign(np.round(mine * w, 9)) if sign is None else np.where(sign == 0, np.sign(np.round(mine * w, 9)), sign)
            assert np.allclose(mine, w * np.where(sign == 0, 1, sign), atol=tolerance)
    assert len(got) == sum(len(v) for v in want.values()) * len(explained)


@pytest.mark.parametrize("d", [1, 5, 16, 40])
def test_equals_eigenvectors(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, (rng.normal(size=d) * 3.0 ** -np.arange(d).clip(0, 6) + np.arange(d)).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, component string").repartition(5)
    check(whitening.whiten(df).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)] + [(3, [1.0, 2.0, 3.0]), (None, [4.0, -2.0, 3.0]), (40, None), (41, []), (42, [1.0, None, 2.0])]
    rows += [(43, [float("nan"), 1.0, 1.0]), (44, [1.0, float("-inf"), 1.0])]
    rows += [(100 + i, [1.0, 2.0, 3.0]) for i in range(200)]  # copies count once
    df = spark.createDataFrame(rows + [(7, [1.0])], "vec_id long, embedding array<double>")
    check(whitening.whiten(df).collect(), rows)


def test_directions_without_variance_are_left_out(spark):
    rng = np.random.default_rng(9)
    wide = [(i, [float(a), float(2 * a), 7.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-9, 9, (50, 2)))]
    got = whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and all(r.identity_error < 1e-9 for r in got)
    check(got, wide, k=2)
    same = [(i, [1.0, 2.0]) for i in range(5)]
    assert whitening.whiten(spark.createDataFrame(same, "vec_id long, embedding array<double>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_ill_conditioned_rows_keep_their_small_components(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * [1e7, 1e4, 10.0, 1.0]).tolist()) for i in range(300)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and all(r.identity_error < 1e-6 for r in got)


def test_whole_numbers_beyond_longs():
    x = np.array([[1 << 31, -(1 << 31)], [5, 7]], np.int64)
    sums = np.array([1 << 60, 3], object)
    gap = whitening.centred(x, 1 << 33, sums)
    assert gap[0].tolist() == [(1 << 64) - (1 << 60), -(1 << 64) - 3] and whitening.deviations(gap)[0] is None
    assert whitening.deviations(np.array([[1 << 31, 1], [2, 3]], object)) == [(1 << 62) + 1, 13]


def test_embeddings_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op12_whitening"](spark, sf).withColumnRenamed("vec_id", "id").collect(), rows)
