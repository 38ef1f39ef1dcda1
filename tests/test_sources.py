import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from daytrace.operators import report as rp
from daytrace.sources import files as src
from daytrace.sources import sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_event_arrays_keep_positions(spark, tmp_path):
    for u, n in (("ann", 5), ("bob", 3)):
        put(tmp_path / u / "mouse_events.json", json.dumps(
            [{"timestamp": f"2025-01-01T00:00:0{i}", "event_type": "drag", "data": {"x": i, "y": None, "action": "down"}} for i in range(n)]))
    df = src.read_events(spark, f"{tmp_path}/*/mouse_events.json", src.MOUSE_DATA)
    assert rows(df, "user", "ord", "data.x") == [("ann", i, float(i)) for i in range(5)] + [("bob", i, float(i)) for i in range(3)]
    assert df.where("ts is null").count() == 0


def test_snapshots_accept_both_shapes_and_keep_key_order(spark, tmp_path):
    one = {"accessibility": {"data": {"zeta": "b", "alpha": "a"}}}
    put(tmp_path / "ann" / "accessibility.json", json.dumps([one, {}]))
    put(tmp_path / "bob" / "accessibility.json", json.dumps({"records": [{}, one]}))
    got = {(r["user"], r["ord"]): r["accessibility"] for r in src.read_snapshots(spark, f"{tmp_path}/*/accessibility.json").collect()}
    assert all(list(json.loads(got[k])["data"].items()) == [("zeta", "b"), ("alpha", "a")] for k in (("ann", 0), ("bob", 1)))
    assert got[("bob", 0)] is None and got[("ann", 1)] is None and len(got) == 4


def test_lines_tolerant_strict_and_last_wins(spark, tmp_path):
    p = put(tmp_path / "s.jsonl", '{"pair_idx": 1, "summary": "old"}\n\n{bad\n{"pair_idx": 2, "summary": " x "}\n{"pair_idx": 1, "summary": "new"}\n')
    lines = src.read_lines(spark, p)
    got = src.last_per_pair(src.parse_lines(lines, "pair_idx bigint, summary string"), ["file"])
    assert rows(got, "pair_idx", "summary") == [(1, "new"), (2, " x ")]
    assert rows(src.observations(got, [], "summary"), "batch_id", "text") == [(1, "new"), (2, "x")]
    with pytest.raises(Exception):
        src.parse_lines(lines, "pair_idx bigint, summary string", strict=True).collect()


def test_statement_files_of_all_shapes(spark, tmp_path):
    a = put(tmp_path / "propositions.jsonl", json.dumps({"proposition": " one ", "batch_id": 3}) + "\n" + json.dumps(
        {"batch_id": 4, "propositions": [{"proposition": "two", "confidence": 5}, {"proposition": " "}]}) + "\n" + json.dumps({"error": "x"}) + "\n")
    b = put(tmp_path / "x" / "propositions.csv", 'proposition,confidence,decay\n"said ""hi""\nthere",7,1\n ,1,1\nlast,n/a,2\n')
    got = src.read_statements(spark, [a, b])
    assert rows(got, "text") == [("last",), ("one",), ('said "hi"\nthere',), ("two",)]
    assert {r["text"]: (r["batch_id"], r["confidence"]) for r in got.collect()}["two"] == (4, "5")


def test_folder_listing_preferences_and_latest(spark, tmp_path):
    for name in ("ann/ax_gpt_5/propositions.csv", "ann/ax_gpt_5/propositions.jsonl", "ann/ax_b/propositions.jsonl", "ann/zip_b/propositions.csv",
                 "ann/raw/app_events_2.json", "ann/raw/app_events_10.json", "bob/raw/app_events.json", "bob/raw/app_events_9.json",
                 "ann/merged+ax+ocr_b/propositions.csv", "ann/screen/frame_2_idx_1.jpg"):
        put(tmp_path / name, "x")
    files = src.list_files(spark, str(tmp_path))
    parsed = src.parse_folders(files, ["ax", "metadata"])
    assert rows(parsed.select("user", "modality", "model").distinct()) == [("ann", "ax", "b"), ("ann", "ax", "gpt_5")]
    assert rows(src.first_folder(parsed, ["user", "modality"]).select("folder").distinct()) == [("ax_b",)]
    assert rows(src.preferred_files(parsed), "folder", "name") == [("ax_b", "propositions.jsonl"), ("ax_gpt_5", "propositions.csv")]
    late = src.latest_file(src.parse_folders(files), "app_events", ["user"])
    assert sorted((r["user"], r["path"].split("/")[-1]) for r in late.collect()) == [("ann", "app_events_2.json"), ("bob", "app_events.json")]
    assert rows(src.discover_models(parsed)) == [("ann", "b")]
    assert rows(src.merged_runs(src.parse_folders(files), "merged"), "mods", "model") == [("merged+ax+ocr", "b")]
    assert src.frame_files(files).count() == 1


def test_run_results(spark, tmp_path):
    head = "status,candidate_count,eval_count,f1_score\n"
    put(tmp_path / "ann" / "m1" / "none__ax+ocr.csv", head + "ok,10,0,0.5\nok,99,99,0.9\n")
    put(tmp_path / "ann" / "m1" / "rerank__merged+ax.csv", head + "ok,10,7,bad\n")
    put(tmp_path / "ann" / "m1" / "comparison.csv", head)
    got = src.run_results(spark, str(tmp_path), ["f1_score"])
    assert sorted(tuple(r) for r in got.select("user", "model", "method", "modalities", "eval_count", F.coalesce("f1_score", F.lit(-1.0))).collect()) == [
        ("ann", "m1", "none", "ax+ocr", 10.0, 0.5), ("ann", "m1", "rerank", "ax", 7.0, -1.0)]


def test_runs_with_different_headers(spark, tmp_path):
    put(tmp_path / "ann b" / "m1" / "none__ax.csv", "status,candidate_count,count_ax,eval_count,f1_score\nok,10,4,8,0.5\n")
    put(tmp_path / "ann b" / "m1" / "rerank__ax+ocr.csv", "status,candidate_count,count_ax,count_ocr,eval_count,f1_score\nok,10,3,0,25,0.25\n")
    put(tmp_path / "ann b" / "m1" / "none.csv", "modalities,f1_score,status\nax,0.1,ok\n")
    put(tmp_path / "ann b" / "m1" / "m__x__y.csv", "f1_score,status\n0.2,ok\n")
    got = src.run_results(spark, str(tmp_path), ["f1_score"], ["ax", "ocr"])
    seen = {tuple(r) for r in got.select("method", "modalities", "eval_count", "count_ax", "count_ocr", "f1_score").collect()}
    assert seen == {
        ("none", "ax", 8.0, 4.0, None, 0.5), ("rerank", "ax+ocr", 25.0, 3.0, 0.0, 0.25), ("none", "ax", None, None, None, 0.1), ("m", "x__y", None, None, None, 0.2)}
    cells = rp.resolve_runs(got)
    assert rows(cells.where("method = 'rerank'"), "modalities", "native") == [("ax", False)]


def test_plain_text_sources(spark, tmp_path):
    p = put(tmp_path / "profile.md", "line one\nline two\n")
    q = put(tmp_path / "claims.txt", "a\n\n  b \n")
    assert src.read_documents(spark, p).first()["text"] == "line one\nline two\n"
    assert rows(src.read_claims(spark, q), "text") == [("a",), ("b",)]


def test_sinks_round_trip_and_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("u", "ax", "m", 1, None), ("u", "ocr", "m", 2, "t")], "user string, modality string, model string, pair_idx long, summary string")
    out = str(tmp_path / "layer")
    sinks.write_layer(df, out)
    sinks.write_layer(df, out, append=True)
    back = spark.read.json(out)
    assert back.count() == 4 and back.where("modality = 'ax' and summary is null").count() == 2
    rec = spark.createDataFrame([("u", 0, 60.0, None)], "user string, id long, duration double, note string")
    sinks.write_metadata(rec, str(tmp_path / "meta"))
    assert spark.read.text(str(tmp_path / "meta") + "/*/*.json").first()[0] == '{"id":0,"duration":"60.00s"}'
    with pytest.raises(Exception):
        sinks.write_metadata(rec, str(tmp_path / "meta"))
    sinks.write_csv(spark.createDataFrame([('a "q"\nb', 1)], "t string, n int"), str(tmp_path / "csv"))
    assert src.read_csv(spark, str(tmp_path / "csv"), "t string, n int").first()["t"] == 'a "q"\nb'
    sinks.write_manifest(spark, str(tmp_path / "params"), user="u", modalities=["ax", "ocr"], k=5)
    assert spark.read.json(str(tmp_path / "params")).first()["modalities"] == "ax+ocr"
    m = sinks.distance_matrix(spark.createDataFrame([("a", "a", 0.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 0.0)], "a string, b string, distance double"))
    assert [tuple(r) for r in m.collect()] == [("a", None, 0.5), ("b", 0.5, None)]
