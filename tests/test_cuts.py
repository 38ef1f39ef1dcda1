import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from daytrace.operators.cuts import CHUNK, fit
from daytrace.operators.ordered import Ordered, chunked_fold


def burst(spark):
    """A quiet user over a year, one who is busy for two seconds of it, one without a key, rows without a time."""
    rnd = random.Random(5)
    year = 365 * 86_400
    data = [("quiet", rnd.randrange(year), i) for i in range(60)]
    data += [("burst", 1_000_000 + rnd.random() * 2, 1_000 + i) for i in range(1_500)] + [("burst", year, 9_000), ("burst", 0, 9_001)]
    data += [(None, 7.0, 10_000 + i) for i in range(300)] + [("burst", None, 20_000 + i) for i in range(90)]
    df = spark.createDataFrame([(u, None if t is None else float(t), i) for u, t, i in data], "u string, t double, id long")
    return df.select("u", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "id")


def test_a_burst_and_rows_of_one_time_are_cut(spark):
    df = burst(spark)
    cuts = fit(df, ["u"], ["ts", "id"], target_rows=50)
    sizes = cuts.split(df).groupBy("u", CHUNK).count()
    assert sizes.agg(F.max("count")).first()[0] <= 100
    assert sizes.where("u = 'quiet'").count() <= 3 and sizes.where("u is null").count() >= 3
    assert cuts.split(df).columns == [*df.columns, CHUNK] and cuts.split(df).count() == df.count()


def test_chunks_follow_the_order(spark):
    df = burst(spark)
    got = fit(df, ["u"], ["ts", "id"], target_rows=40).split(df).collect()
    for key in ("quiet", "burst", None):
        own = sorted((r for r in got if r["u"] == key), key=lambda r: (r["ts"] is not None, r["ts"] or 0, r["id"]))
        assert [r[CHUNK] for r in own] == sorted(r[CHUNK] for r in own)


def test_rows_alike_in_every_order_column_stay_together(spark):
    df = spark.createDataFrame([("a", 5, 1)] * 200 + [("a", 6, 1), ("a", 4, 1)], "u string, i long, id long")
    sizes = fit(df, ["u"], ["i", "id"], target_rows=20).split(df).groupBy("u", CHUNK).count()
    assert rows(sizes, "count") == [(1,), (1,), (200,)]


def test_many_levels_where_one_has_few_parts(spark, monkeypatch):
    from daytrace.operators import cuts as module

    monkeypatch.setattr(module, "PARTS", 3)
    df = spark.range(2_000).select(F.lit("a").alias("u"), F.col("id").alias("i"))
    cuts = fit(df, ["u"], ["i"], target_rows=100)
    assert len(cuts.levels) > 1 and cuts.split(df).groupBy(CHUNK).count().agg(F.max("count")).first()[0] <= 200


def test_small_and_empty_tables_need_no_cuts(spark):
    df = burst(spark)
    assert fit(df, ["u"], ["ts"]) is None and fit(df.limit(0), ["u"], ["ts"], 1) is None
    with pytest.raises(ValueError):
        fit(df, ["u"], ["u"], 1)


@pytest.mark.parametrize("broadcast_parts", [0, 10_000])
def test_windows_and_folds_over_cuts_equal_plain_ones(spark, monkeypatch, broadcast_parts):
    from daytrace.operators import cuts as module

    monkeypatch.setattr(module, "BROADCAST_PARTS", broadcast_parts)
    df = burst(spark)
    cuts = fit(df, ["u"], ["ts", "id"], target_rows=60)

    def made(chunk):
        o = Ordered(df, ["u"], ["ts", "id"], chunk).ordinal("n").lag("before", F.col("id")).lead("after", F.col("id"))
        return sorted((tuple(r) for r in o.running_sum("s", F.col("id")).fill("f", F.when(F.col("id") % 7 == 0, F.col("id"))).done().collect()), key=str)

    def step(state, row):  # forgets all but the row before: a few rounds settle it
        before, state["n"] = state["n"], int(row[0]) % 7
        return int(row[0]), before

    def folded(chunk):
        return sorted((tuple(r) for r in chunked_fold(df, ["u"], ["ts", "id"], chunk, ["id"], lambda: {"n": 0}, step, "id bigint, n bigint").collect()), key=str)

    assert made(cuts) == made(None) and len(made(None)) == df.count()
    if broadcast_parts:
        assert folded(cuts) == folded(None)
