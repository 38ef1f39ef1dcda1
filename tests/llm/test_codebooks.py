import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrace.llm import codebooks


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(id, code, error) of usable rows and the digest of the codebooks, by plain loops over whole numbers"""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return [], None
    d = len(kept[0][1])
    whole = lambda v: [math.floor(scale * c) for c in v] + [0] * (-d % parts)
    kept = sorted(((i, whole(v)) for i, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    p = -(-d // parts)
    cut = lambda v, k: v[k * p : (k + 1) * p]
    books = [[cut(v, k) for _, v in kept[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        near = [[min((far(cut(v, k), c), e) for e, c in enumerate(books[k])) for k in range(parts)] for _, v in kept]
        if turn < rounds:
            for k in range(parts):
                for e in range(len(books[k])):
                    own = [cut(v, k) for (_, v), m in zip(kept, near) if m[k][1] == e]
                    if own:
                        books[k][e] = [sum(x) // len(own) for x in zip(*own)]
    text = ",".join(str(x) for b in books for c in b for x in c)
    return [(i, [e for _, e in m], sum(f for f, _ in m)) for (i, _), m in zip(kept, near)], hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, k % 3, "x", 1) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, label int, code string, error int")
    got = codebooks.compress(df.repartition(3), **options).collect()
    want, mark = brute(rows, **{k: v for k, v in options.items() if k in ("parts", "entries", "rounds", "scale")})
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r.id, r.code, r.error) for r in got], key=order) == sorted(want, key=order)
    assert {r.codebooks_sha256 for r in got} == ({mark} if mark else set())


@pytest.mark.parametrize("listed", [(4, 16, 64), (1, 1, 2), (1, 2, 40), (0, 0, 0)])
@pytest.mark.parametrize("spread", [0.004, 1.0])
def test_codes_equal_a_full_search(spark, listed, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + spread * rng.normal(size=8)).tolist()) for i in range(240)]
    check(spark, rows, entries=40, rounds=5, listed=listed, scale=64)


def test_bounds_spare_most_looks_once_entries_settle(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + 0.01 * rng.normal(size=8)).tolist(), 0) for i in range(900)]
    looks = []
    codebooks.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=30, rounds=5, looks=looks).collect()
    assert max(looks[-1]) < 0.05 and looks[0] == [1.0] * 4


def test_odd_rows(spark):
    rows = [(5, [1.5, -0.25, 3.0]), (5, [1.5, -0.25, 3.0]), (5, [0.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0]), (2, [1.0, -1e-9, 2.0]), (1, None), (3, [1.0, None, 2.0])]
    rows += [(4, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, []), (8, [3e4, -3e4, 3e4]), (9, [-3e4, 3e4, -3e4])]
    check(spark, rows)
    check(spark, rows, entries=2, rounds=1)
    check(spark, rows, entries=1)
    check(spark, [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(9)], entries=4)
    check(spark, [(1, None)])
    check(spark, [])


def test_vectors_beyond_the_bound_are_held_at_it(spark):
    df = spark.createDataFrame([(1, [1e30] * 4, 0), (2, [-1e30] * 4, 0), (3, [0.0] * 4, None), (4, [1.0] * 3, None)], "vec_id long, embedding array<double>, label int")
    got = {r.id: r.error for r in codebooks.compress(df).collect()}
    assert got == {1: 0, 2: 0, 3: 0}


@pytest.mark.parametrize("broadcast", [1_000_000, 1])
def test_errors_add_up_by_label(spark, broadcast):
    rows = [(1, None, [0], 5), (2, None, [0], 6), (3, 7, [0], 1), (4, 7, [0], 2), (5, 8, [0], 0)]
    coded = spark.createDataFrame(rows, "id long, label int, code array<int>, error long")
    got = {r.id: r.label_error for r in codebooks.with_label_error(coded, broadcast).collect()}
    assert got == {1: 11, 2: 11, 3: 3, 4: 3, 5: 0}


def test_close_distances_are_settled_in_whole_numbers():
    big = (1 << 26) - 1
    book = np.array([[big, -big, big, 2], [big, -big, big, -2], [-big, big, -big, 0]], np.int64)
    x = np.array([[-big, big, -big, 0], [-big, big, -big + 1, 0], [0, 0, 0, 0]], np.int64)
    bounds, exact = codebooks.full_search(x, book[:2], 1)
    assert bounds.entry.tolist() == [0, 0, 0] and exact.tolist() == [((x[k] - book[0]) ** 2).sum() for k in range(3)]
    assert codebooks.full_search(x, book, 2)[0].entry.tolist() == [2, 2, 2 if 3 * big**2 < 3 * big**2 + 4 else 0]


def test_codes_in_hex(spark):
    assert spark.range(1).select(codebooks.hex_code(F.array(F.lit(0), F.lit(10), F.lit(255)))).first()[0] == "000aff"
