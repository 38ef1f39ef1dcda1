import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from daytrace.llm import rabitq


def brute(rows, k, asks):
    out = {}
    for a, (i, v) in enumerate(rows):
        if asks(i):
            best = sorted((-float(np.dot(v, w)), j, b) for b, (j, w) in enumerate(rows) if b != a)[:k]
            out.setdefault(i, []).append([(j, -s) for s, j, _ in best])
    return out


def searched(spark, rows, k=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int, score string")
    return rabitq.search(df, F.col("vec_id") % 20 == 0, k, **options)


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist(), 0, "x") for i in range(1200)]
    got = searched(spark, rows, 20, block_rows=200, query_rows=16).toPandas()
    plain = [(i, np.float32(v).astype(float)) for i, v, *_ in rows]
    want = brute(plain, 20, lambda i: i % 20 == 0)
    hits = 0
    for i, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        hits += len(set(part["vec_id"]) & {j for j, _ in want[i][0]})
        assert part["rank"].tolist() == list(range(1, 21)) and (part["score"].diff().dropna() <= 0).all()
        v = dict(plain)
        assert np.allclose(part["score"], [np.dot(v[i], v[j]) for j in part["vec_id"]])
    assert hits >= 0.98 * 20 * len(want)


def test_ties_repeats_and_unusable_rows(spark):
    same = [1.0, 0.0, 2.0]
    rows = [(i, same, 0, None) for i in (0, 3, 1, 2, 2)]
    rows += [(4, None, 0, None), (5, [0.0, 0.0, 0.0], 0, None), (6, [1.0, None, 1.0], 0, None), (7, [1.0, float("nan"), 0.0], 0, None)]
    rows += [(8, [float("inf"), 0.0, 1.0], 0, None), (None, same, 0, None), (9, [1.0], 0, None), (10, [], 0, None)]
    got = sorted(tuple(r) for r in searched(spark, rows).collect())
    assert got == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 2, 5.0), (0, 4, 3, 5.0)]


def test_empty_table_and_lone_query(spark):
    assert searched(spark, []).count() == 0
    assert searched(spark, [(20, [1.0, 2.0], 0, None)]).count() == 0


def test_the_shipped_bound_holds_the_exact_products():
    rng = np.random.default_rng(4)
    v, q, centre = rng.normal(size=(300, 48)), rng.normal(size=(20, 48)), rng.normal(size=48)
    turn = rabitq.rotation(48)
    guess, error = rabitq.estimate(*rabitq.encode(v, centre, turn), q, centre, turn)
    assert (np.abs(guess - q @ v.T) <= error).mean() > 0.99


def test_bounds_hold_the_exact_products():
    rng = np.random.default_rng(4)
    v, q, centre = rng.normal(size=(300, 48)), rng.normal(size=(20, 48)), rng.normal(size=48)
    turn = rabitq.rotation(48)
    assert np.allclose(turn @ turn.T, np.eye(48))
    guess, error = rabitq.estimate(*rabitq.encode(v, centre, turn), q, centre, turn, epsilon=3.0)
    assert (np.abs(guess - q @ v.T) <= error).mean() > 0.99
    off = guess - q @ v.T
    assert abs(off.mean()) < 0.1 * np.abs(off).mean()  # estimates lean to neither side


def test_a_block_gathers_no_pair_of_vectors_for_each_pair_the_bounds_leave():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4096, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[4001] = v[17]  # copies tie in whatever place of a block
    ids, turn, centre = np.arange(4096), rabitq.rotation(64), v.mean(0)
    codes, length, along = rabitq.encode(v, centre, turn)
    block = {"key": ids, "id": ids, "v": v, "codes": codes, "length": length, "along": along}
    queries = {"key": ids[:64], "id": ids[:64], "v": v[:64]}
    tracemalloc.start()
    got = rabitq.best_of_block(block, queries, centre, turn, 20, rabitq.EPSILON)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    guess, error = rabitq.estimate(codes, length, along, queries["v"], centre, turn)
    guess[np.arange(64), np.arange(64)] = -np.inf
    least = np.sort(guess - error, axis=1)[:, -20]
    for i, part in got.groupby("query_key"):
        left = np.flatnonzero(guess[i] + error[i] >= least[i])
        scores = np.einsum("ij,ij->i", np.tile(v[i], (len(left), 1)), v[left])
        best = np.lexsort((left, -scores))[:20]
        assert part["vec_id"].tolist() == left[best].tolist() and part["score"].tolist() == scores[best].tolist()
    assert len(got) == 64 * 20 and peak < 60e6
