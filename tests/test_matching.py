import numpy as np
import pytest
from conftest import rows

from daytrace.operators.matching import match_sets

SCHEMA = "k string, id long, n long, vec array<float>"


def made(seed, many, d, spread):
    """Two sides of crowds of near copies (spread of the crowd) and lone rows, with copies, one key null."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(3, d))
    sides = []
    for _ in range(2):
        side = []
        for i in range(many):
            v = heads[i % 3] + rng.normal(scale=spread, size=d) if i % 2 else rng.normal(size=d)
            side.append((None if i % 5 == 0 else "a", i, int(rng.integers(1, 4)), (v / np.linalg.norm(v)).astype(np.float32).tolist()))
        sides.append(side)
    return sides


def greedy(left, right, threshold):
    """The pass over all single pairs, key by key."""
    taken = []
    for key in {r[0] for r in left}:
        l, r = ([x for x in side if x[0] == key] for side in (left, right))
        sims = np.array([x[3] for x in l], float) @ np.array([x[3] for x in r], float).T
        nl, nr = [x[2] for x in l], [x[2] for x in r]
        for cos, _, _, a, b in sorted(((sims[a, b], l[a][1], r[b][1], a, b) for a in range(len(l)) for b in range(len(r)) if sims[a, b] >= threshold), reverse=True):
            m = min(nl[a], nr[b])
            if m:
                nl[a] -= m
                nr[b] -= m
                taken.append((str(key), l[a][1], r[b][1], m))
    return sorted(taken)


@pytest.mark.parametrize("spread,per_row,block_rows", [(0.3, 4, 2048), (1e-3, 4, 30)])
def test_bands_equal_one_pass_and_list_few_pairs(spark, spread, per_row, block_rows):
    left, right = made(5, 120, 6, spread)
    bands = []
    got = match_sets(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"], 0.2, per_row, 1, block_rows, bands)
    assert sorted((str(k), i, j, m) for k, i, j, m in rows(got.na.fill("None", ["k"]), "k", "i", "j", "m")) == greedy(left, right, 0.2)
    everything = sum(1 for a in left for b in right if a[0] == b[0] and np.dot(np.array(a[3], float), np.array(b[3], float)) >= 0.2)
    assert len(bands) > 1 and max(bands) <= per_row * 240 < everything / 2


def test_one_side_empty(spark):
    left, _ = made(5, 10, 6, 0.3)
    assert match_sets(spark.createDataFrame(left, SCHEMA), spark.createDataFrame([], SCHEMA), ["k"], 0.2).count() == 0
