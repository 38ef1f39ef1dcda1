import math

import numpy as np
import pytest
from conftest import rows

from daytrace.operators import graph, similarity as sim
from daytrace.operators.graph import connected_components, first_come_set, greedy_matching


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6))
    out = []
    for i in range(90):
        v = base[i % 12] + rng.normal(scale=0.4, size=6) if i % 3 else base[0]  # a third of all rows are copies
        v = (v / np.linalg.norm(v)).astype(np.float32)
        out.append(("hot" if i % 5 else "cold", "s" if i % 2 else "r", i, [float(x) for x in v]))
    df = spark.createDataFrame(out, "user string, side string, id long, vec array<float>")
    return df.cache(), out


def groups(out):
    for u in ("hot", "cold"):
        mine = [o for o in out if o[0] == u]
        yield u, mine, np.array([o[3] for o in mine], dtype=np.float32).astype(float)


@pytest.mark.parametrize("block", [5, 1000])
def test_pairs_above(data, block):
    df, out = data
    want = []
    for u, mine, m in groups(out):
        s = m @ m.T
        want += [(u, a[2], b[2]) for x, a in enumerate(mine) for y, b in enumerate(mine) if a[2] < b[2] and s[x, y] >= 0.8]
    assert rows(sim.pairs_above(df, ["user"], 0.8, block_rows=block), "user", "i", "j") == sorted(want)


@pytest.mark.parametrize("block", [4, 1000])
def test_top_matches_both_sides(data, block):
    df, out = data
    got = {(r["user"], r["side"], r["id"], r["rank"]): r["other"] for r in sim.top_matches(
        df.where("side = 's'"), df.where("side = 'r'"), ["user"], k=3, block_rows=block).collect()}
    for u, mine, m in groups(out):
        s = m @ m.T
        for x, a in enumerate(mine):
            others = sorted(((s[x, y], b[2]) for y, b in enumerate(mine) if b[1] != a[1]), reverse=True)[:3]
            assert [got[(u, "left" if a[1] == "s" else "right", a[2], k + 1)] for k in range(3)] == [o for _, o in others]


def test_coverage_sums(data):
    df, out = data
    got = {(r["user"], r["id"]): r for r in sim.coverage_sums(df, ["user"], 0.3, 0.9, block_rows=7).collect()}
    for u, mine, m in groups(out):
        mu = np.clip((m @ m.T - 0.3) / 0.6, 0, 1)
        is_s = np.array([o[1] == "s" for o in mine])
        for x, a in enumerate(mine):
            r = got[(u, a[2])]
            assert np.allclose([r["sum_s"], r["sum_r"], r["max_s"], r["max_r"]],
                               [mu[x, is_s].sum(), mu[x, ~is_s].sum(), mu[x, is_s].max(), mu[x, ~is_s].max()])


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(root))


@pytest.mark.parametrize("block", [5, 1000])
def test_component_stars_connect_what_pairs_connect(data, block):
    df, out = data
    stars = [(r["i"], r["j"]) for r in sim.component_stars(df, ["user"], 0.8, block_rows=block).collect()]
    pairs = [(r["i"], r["j"]) for r in sim.pairs_above(df, ["user"], 0.8).collect()]
    assert components(stars) == components(pairs)
    if block == 1000:
        assert len(stars) < 90  # and not the square of the copies


def test_binned_pairs_are_the_smallest_draws(data):
    df, out = data
    got = rows(sim.binned_pairs(df, ["user"], 0.0, 0.25, 4, per_bin=6, block_rows=8), "user", "bin", "i", "j")
    want = []
    for u, mine, m in groups(out):
        s = m @ m.T
        for b in range(4):
            c = [(int(sim.pair_draw(a[2], d[2])), a[2], d[2]) for x, a in enumerate(mine) for y, d in enumerate(mine)
                 if a[2] < d[2] and b * 0.25 <= s[x, y] < (b + 1) * 0.25]
            want += [(u, b, i, j) for _, i, j in sorted(c)[:6]]
    assert got == sorted(want)


def test_collapse_copies(data):
    df, out = data
    reps, tagged = sim.collapse_copies(df, ["user"], ["vec"], df["id"] >= 0)
    assert reps.count() == len({(o[0], tuple(o[3])) for o in out}) and tagged.count() == 90
    first = {}
    for o in sorted(out, key=lambda o: o[2]):
        first.setdefault((o[0], tuple(o[3])), o[2])
    assert rows(tagged, "id", "rep") == sorted((o[2], first[(o[0], tuple(o[3]))]) for o in out)


def random_edges(n, m, seed):
    rng = np.random.default_rng(seed)
    e = {tuple(sorted(int(x) for x in rng.choice(n, 2, replace=False))) for _ in range(m)}
    return sorted(e | {(i, i + 1) for i in range(100, 120)})  # and a path, the slow case for rounds


@pytest.mark.parametrize("limit", [0, 10, 10_000])
def test_connected_components(spark, limit):
    edges = random_edges(80, 70, 1)
    df = spark.createDataFrame(edges, "i long, j long")
    assert rows(connected_components(df, fold_edges=limit)) == components(edges)


@pytest.mark.parametrize("rounds,limit", [(50, 0), (1, 15), (2, 10_000)])
def test_first_come_set_is_the_sequential_gate(spark, rounds, limit):
    edges = random_edges(80, 120, 2)
    df = spark.createDataFrame(edges, "i long, j long")
    kept = set()
    nodes = sorted({x for e in edges for x in e})
    for x in nodes:
        if not any(b == x and a in kept for a, b in edges):
            kept.add(x)
    got = rows(first_come_set(df, rounds_before_fold=rounds, fold_edges=limit))
    assert got == [(x, x in kept) for x in nodes]


@pytest.mark.parametrize("rounds,limit", [(50, 0), (1, 10), (2, 10_000)])
def test_greedy_matching_with_copies(spark, rounds, limit):
    rng = np.random.default_rng(3)
    pairs = [("k", int(i), int(j), float(rng.integers(1, 6)) / 10) for i in range(12) for j in range(10) if rng.random() < 0.5]
    left = {i: int(rng.integers(1, 4)) for i in range(12)}
    right = {j: int(rng.integers(1, 4)) for j in range(10)}
    l, r, want = dict(left), dict(right), []
    for _, i, j, s in sorted(pairs, key=lambda p: (p[3], p[1], p[2]), reverse=True):
        m = min(l[i], r[j])
        if m:
            l[i] -= m
            r[j] -= m
            want.append((i, j, m))
    df = spark.createDataFrame(pairs, "k string, i long, j long, cos double")
    cap = lambda d: spark.createDataFrame([("k", a, b) for a, b in d.items()], "k string, id long, n long")
    assert rows(greedy_matching(df, cap(left), cap(right), ["k"], rounds_before_fold=rounds, fold_edges=limit), "i", "j", "m") == sorted(want)


@pytest.mark.parametrize("fold_edges", [0, 200_000])
def test_graph_steps_keep_null_keys_on_both_sides_of_the_switch(spark, fold_edges):
    edges = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("k", 1, 2), ("k", 5, 6)], "user string, i long, j long")
    comp = {(r["user"], r["id"], r["component"]) for r in graph.connected_components(edges, ["user"], fold_edges=fold_edges).collect()}
    assert comp == {(None, 1, 1), (None, 2, 1), (None, 3, 1), ("k", 1, 1), ("k", 2, 1), ("k", 5, 5), ("k", 6, 5)}
    kept = {(r["user"], r["id"]) for r in graph.first_come_set(edges, ["user"], fold_edges=fold_edges).where("kept").collect()}
    assert kept == {(None, 1), (None, 3), ("k", 1), ("k", 5)}


def test_binned_pairs_in_strips_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    made = spark.createDataFrame([("u", i, [float(x) for x in v[i]]) for i in range(90)], "user string, id long, vec array<double>")
    cos = v @ v.T
    want = {}
    for i in range(90):
        for j in range(i + 1, 90):
            b = math.floor(cos[i, j] / 0.25)
            if 0 <= b < 4:
                want.setdefault(b, []).append((int(sim.pair_draw(i, j)), i, j))
    want = sorted((b, i, j) for b, ps in want.items() for _, i, j in sorted(ps)[:7])
    for block_rows in (16, 2048):
        assert rows(sim.binned_pairs(made, ["user"], 0.0, 0.25, 4, 7, block_rows=block_rows), "bin", "i", "j") == want


def test_binned_pairs_hold_a_strip_of_a_block_pair_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(6)
    v = rng.normal(size=(2048, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    tracemalloc.start()
    found = sim._smallest_draws(v, v, np.arange(2048), np.arange(2048, 4096), False, 0.0, 0.1, 5, 40, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) == 200 and peak < 60e6


def test_quantiles_of_all_pairs_are_exact(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 3))
    v[40:50] = v[0]  # copies: many equal cosines
    v /= np.linalg.norm(v, axis=1)[:, None]
    made = spark.createDataFrame([("ab"[i % 3 == 0], i, [float(x) for x in v[i]]) for i in range(60)], "user string, id long, vec array<double>")
    of = {u: [float(v[i] @ v[j]) for i in range(60) for j in range(i + 1, 60) if ("ab"[i % 3 == 0], "ab"[j % 3 == 0]) == (u, u)] for u in "ab"}
    of[None] = of["a"] + of["b"]
    got = {r["user"]: r for r in sim.pair_quantiles(made, "user", (0.5, 0.9, 0.99), block_rows=16).collect()}
    assert set(got) == {"a", "b", None}
    for u, cos in of.items():
        assert got[u]["n"] == len(cos) and abs(got[u]["mean"] - np.mean(cos)) < 1e-12
        assert np.allclose(got[u]["q"], np.quantile(cos, (0.5, 0.9, 0.99)), atol=1e-12, rtol=0)
