"""Large files read by byte ranges equal the whole read, wherever the borders fall."""

import csv
import json
import random

import pytest
from conftest import rows
from test_sources import put

from daytrace.sources import files as src
from daytrace.sources import ranges

ODD = ['plain', 'a } b { "q" \\', '}{][,"', '\\"}', 'line\nbreak', 'ünï} 漢字', '', '}' * 40, '"' * 7 + '{', "\\\\" * 3]


@pytest.fixture
def small_ranges(spark):
    key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key), spark.conf.get(cost)
    spark.conf.set(key, "700")
    spark.conf.set(cost, "1")
    yield
    spark.conf.set(key, before[0])
    spark.conf.set(cost, before[1])


def events(seed, n):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(ODD) for _ in range(draw.randint(0, 3)))
    return [{"timestamp": f"2025-01-01T00:00:{i % 60:02d}", "event_type": word(), "data": {"app_name": word(), "window_titles": [word(), word()]}, "more": [{}, {"x": {"y": "{"}}]} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(spark, tmp_path, small_ranges, indent):
    for user, n in (("ann", 120), ("bob", 1), ("cy", 0), ("di", 37)):
        put(tmp_path / user / "app_events.json", json.dumps(events(user, n), indent=indent, ensure_ascii=user == "ann"))
    path = f"{tmp_path}/*/app_events.json"
    assert ranges.fragments(spark, path, "}").select("_file", "_block").distinct().count() > 20
    whole, split = (src.read_events(spark, path, src.APP_DATA, split_files=s).select("user", "ord", "timestamp", "event_type", "data.app_name", "data.window_titles") for s in (False, True))
    assert rows(split) == rows(whole) and split.count() == 158
    made = {(u, i): e for u, n in (("ann", 120), ("di", 37)) for i, e in enumerate(events(u, n))}
    assert all(r["event_type"] == made[r["user"], r["ord"]]["event_type"] for r in split.where("user in ('ann', 'di')").collect())


def test_snapshots_of_both_shapes(spark, tmp_path, small_ranges):
    one = {"accessibility": {"data": {"zeta": "b}", "alpha": ["{"]}}, "app_event": None}
    put(tmp_path / "ann" / "accessibility.json", json.dumps([one, {}] * 60))
    put(tmp_path / "bob" / "accessibility.json", json.dumps({"records": [{}, one]}))
    whole, split = (src.read_snapshots(spark, f"{tmp_path}/*/accessibility.json", split_files=s).fillna("") for s in (False, True))
    plain = lambda df: [(r[0], r[1], r[2] and list(json.loads(r[2])["data"].items()), r[3]) for r in rows(df)]
    assert plain(split) == plain(whole) and split.count() == 122


def test_unfinished_and_empty_files(spark, tmp_path, small_ranges):
    put(tmp_path / "a.json", '[{"x": 1}, {"x": {"y": "}"}}, {"x": "cut')
    put(tmp_path / "b.json", "")
    put(tmp_path / "c.json", " [ ]\n")
    put(tmp_path / "d.json", '\n{"x": {}}\n')
    got = ranges.json_objects(spark, str(tmp_path))
    assert sorted((r["_file"][-6:], r["ord"], r["record"]) for r in got.collect()) == [
        ("a.json", 0, '{"x": 1}'), ("a.json", 1, '{"x": {"y": "}"}}'), ("a.json", 2, '{"x": "cut'), ("d.json", 0, '{"x": {}}')]


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_quoted_csv(spark, tmp_path, small_ranges, line_end):
    draw = random.Random(5)
    odd = ["plain", 'say "hi"', "two\nlines", "a,b", "", '"', "x\n\ny", "ünï", "end "]
    for name, head in (("a.csv", ["text", "n"]), ("b.csv", ["n", "other", "text"])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=line_end)
            out.writerow(head)
            for i in range(150):
                text = "".join(draw.choice(odd) for _ in range(3))
                out.writerow([{"text": text, "n": i, "other": text[::-1]}[h] for h in head])
    whole, split = (src.read_csv(spark, str(tmp_path), "text string, n int, other string", split_files=s) for s in (False, True))
    assert ranges.fragments(spark, str(tmp_path), "\n").select("_file", "_block").distinct().count() > 8
    key = lambda df: sorted((r["_file"], r["ord"], r["n"], r["text"] or "", r["other"] or "") for r in df.collect())
    assert key(split) == key(whole) and split.count() == 300 and split.where("n <> ord").count() == 0
