import os

import oracle
import pytest

import __spark_entry__ as entry

SF = os.environ.get("DAYTRACE_TEST_SF", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, con, name):
    ok, note, _ = oracle.compare(spark, con, SF, entry.queries()[name], ORACLES.get(name))
    assert ok, note


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


CHUNKED = ["w1_session_bounds", "j1_session_activity", "w2_islands", "a1_pointer_metrics", "a2_typing_metrics", "f1_typed_text",
           "w7_pairs_within_budget", "a3_a4_observation_batches", "j4_locate_frames", "w8_segment_bounds", "t3_stable_frames"]


@pytest.mark.parametrize("name", CHUNKED)
def test_query_is_the_same_when_keys_are_cut_into_chunks(spark, con, monkeypatch, name):
    from daytrace.operators import cuts
    from daytrace.plans import activity

    made = []

    def fine(df, keys, order):
        made.append(cuts.fit(df, keys, order, target_rows=9))
        return made[-1]

    monkeypatch.setattr(activity, "fit", fine)
    monkeypatch.setattr(activity, "fitting_size", lambda *a, **k: 211)
    monkeypatch.setattr(activity, "dense_size", lambda *a, **k: 7)
    ok, note, _ = oracle.compare(spark, con, SF, entry.queries()[name], ORACLES.get(name))
    assert ok, note
