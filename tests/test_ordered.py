import random

import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from daytrace.operators.ordered import CHUNK, Ordered, chunked_fold, fitting_size, ordinal_chunk, with_halo


def series(spark, n=120, seed=1):
    rnd = random.Random(seed)
    data = [("hot" if rnd.random() < 0.7 else f"u{rnd.randrange(3)}", i, rnd.choice([None, 1, 2, 5])) for i in range(n)]
    return spark.createDataFrame(data, "k string, i long, v int")


def test_all_columns_equal_plain_windows_for_any_chunk(spark):
    df = series(spark)
    w = Window.partitionBy("k").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows(df.select(
        "k", "i", F.lead("v").over(w), F.lag("v").over(w), F.row_number().over(w) - 1,
        F.last("v", ignorenulls=True).over(upto), F.coalesce(F.sum("v").over(upto), F.lit(0)), F.max("v").over(upto)).na.fill(-1))
    for size in (1, 7, 10_000, None):
        got = (
            Ordered(df, ["k"], ["i"], ordinal_chunk("i", size)).lead("a", F.col("v")).lag("b", F.col("v")).ordinal("c")
            .fill("d", F.col("v")).running_sum("e", F.col("v")).running_max("f", F.col("v")).done()
        )
        assert rows(got.select("k", "i", "a", "b", "c", "d", "e", "f").na.fill(-1)) == want


def test_fill_alone_reaches_over_empty_chunks(spark):
    df = spark.createDataFrame([("a", 0, 7), ("a", 50, None), ("a", 99, None), ("b", 5, None)], "k string, i long, v int")
    got = Ordered(df, ["k"], ["i"], ordinal_chunk("i", 10)).fill("f", F.col("v")).done()
    assert rows(got.na.fill(-1), "k", "i", "f") == [("a", 0, 7), ("a", 50, 7), ("a", 99, 7), ("b", 5, -1)]


def test_halo_copies_rows_near_borders(spark):
    df = spark.range(10).select(F.col("id").alias("i"))
    got = rows(with_halo(df, "i", 5, before=2, after=1), CHUNK, "i", "_own")
    assert (1, 3, False) in got and (1, 4, False) in got and (0, 5, False) in got
    assert sum(1 for r in got if r[2]) == 10


def test_chunked_fold_is_the_sequential_fold(spark):
    df = series(spark, 200, 3).na.fill(0)

    def step(state, row):
        i, v = int(row[0]), int(row[1])
        state["s"] = (state["s"] * 3 + v + 1) % 101  # never forgets: every chunk border matters
        return (i, state["s"]) if state["s"] % 2 else None

    want = []
    by_key = {}
    for k, i, v in rows(df):
        by_key.setdefault(k, []).append((i, v))
    for k, seq in by_key.items():
        state = {"s": 0}
        want += [(k, *o) for o in (step(state, r) for r in sorted(seq)) if o]
    for size in (30, 400, None):
        got = chunked_fold(df, ["k"], ["i"], ordinal_chunk("i", size), ["i", "v"], lambda: {"s": 0}, step, "i long, s int")
        assert rows(got) == sorted(want)


def test_fitting_size_follows_the_largest_key(spark):
    df = series(spark)
    hot = df.where("k = 'hot'").count()
    assert fitting_size(df, ["k"], "i", hot) is None
    width = fitting_size(df, ["k"], "i", 10)
    assert 120 / width >= hot / 10 - 1 and fitting_size(df.limit(0), ["k"], "i") is None


NULLS = [("a", 5), ("a", None), (None, 1), (None, 9), ("a", 2), (None, None), ("a", 700)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_null_keys_and_null_order_values_are_the_same_in_chunks(spark, size):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(NULLS)], "u string, i long, id long")

    def made(chunk):
        o = Ordered(df, ["u"], ["i", "id"], chunk).ordinal("n").lag("before", F.col("id")).lead("after", F.col("id"))
        return sorted((tuple(r) for r in o.running_sum("s", F.col("id")).fill("f", F.when(F.col("id") % 2 == 0, F.col("id"))).done().collect()), key=str)

    assert made(ordinal_chunk("i", size)) == made(None) and len(made(None)) == len(NULLS)


@pytest.mark.parametrize("size", [None, 1, 3])
def test_folds_keep_rows_without_key_or_order(spark, size):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(NULLS)], "u string, i long, id long")

    def step(state, row):
        state["n"] += 1
        return int(row[0]), state["n"]

    out = chunked_fold(df, ["u"], ["i", "id"], ordinal_chunk("i", size), ["id"], lambda: {"n": 0}, step, "id bigint, n bigint")
    want = {}
    for key in ("a", None):
        own = sorted(((v is not None, v or 0, i) for i, (k, v) in enumerate(NULLS) if k == key))
        want.update({i: (key, n + 1) for n, (_, _, i) in enumerate(own)})
    assert {r["id"]: (r["u"], r["n"]) for r in out.collect()} == want
