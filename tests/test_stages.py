import json

from conftest import rows
from pyspark.sql import functions as F

from daytrace.functions import text as tx
from daytrace.operators import infer as nf
from daytrace.operators import trees


def test_batch_failure_marks_only_its_rows(spark):
    def client():
        def answer(ps):
            if "bad" in ps:
                raise RuntimeError("x" * 900)
            return [p.upper() for p in ps]

        return answer

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "bad", "c", "d"])], "id long, prompt string").coalesce(1)
    whole = nf.infer(df, "prompt", client, chunk=2).where("id = 2").first()
    assert whole["error"] == "x" * 900
    got = {r["id"]: r for r in nf.infer(df, "prompt", client, chunk=2, error_chars=500).collect()}
    assert [got[i]["text"] for i in range(5)] == ["A", "B", None, None, "D"]
    assert len(got[2]["error"]) == 500 and got[4]["error"] is None and got[0]["stats"]["prompt_tokens"] == 1


def test_statement_validation(spark):
    ok = {"reasoning": "r", "proposition": "p", "confidence": 3, "decay": "10"}
    cases = {
        "good": {"propositions": [ok]}, "extra": {"propositions": [{**ok, "more": 1}]}, "range": {"propositions": [ok, {**ok, "confidence": 11}]},
        "type": {"propositions": [{**ok, "proposition": 5}]}, "missing": {"propositions": [{k: v for k, v in ok.items() if k != "decay"}]},
        "outer": {"propositions": [ok], "note": 1}, "empty": {"propositions": []},
    }
    data = [(k, "```json\n" + json.dumps(v) + "\n```") for k, v in cases.items()] + [("broken", "{oops")]
    got = {r["k"]: r for r in nf.parse_propositions(spark.createDataFrame(data, "k string, text string")).collect()}
    assert {k for k, r in got.items() if r["error"] is None} == {"good", "empty"}
    assert got["good"]["propositions"][0]["decay"] == 10 and got["broken"]["error"] == "no valid JSON in answer"


def test_text_helpers(spark):
    df = spark.createDataFrame([("go go go stop stop",), ("",), ("one",), ("x x",), ("a b b a",)], "t string")
    assert [r[0] for r in df.select(tx.drop_repeated_ending("t")).collect()] == ["go go go stop", "", "one", "x", "a b b a"]
    g = spark.createDataFrame([("5",), ("x",), ("+",), ("True",), ("#abc",), ("#abcdefgh",), ("word",)], "t string")
    assert [r[0] for r in g.select(tx.is_garbage("t")).collect()] == [False, True, False, True, True, False, False]
    d = spark.createDataFrame([("Ghbdsn <cmd+c> [;",)], "t string")
    assert d.select(tx.decode_layout("t")).first()[0] == "Привіт <cmd+c> хж"
    assert spark.range(1).select(tx.token_count(F.lit("a  b"))).first()[0] == 3


def clean(spark, *snapshots, **options):
    df = spark.createDataFrame([(json.dumps(s) if s is not None else None,) for s in snapshots], "raw string")
    return [tuple(r[0]) for r in df.select(trees.clean_snapshot(F.col("raw"), **options)).collect()]


def test_tree_cleaning(spark):
    tree = {"role": "window", "title": "Mail", "children": [
        {"role": "group", "children": [{"role": "button", "name": "Send", "children": [{"role": "text", "name": "Send"}]}]},
        {"role": "slider", "value": 4, "checked": True, "attributes": {"hint": "louder", "url": "http://x"}, "id": "k7"},
        {"role": "text", "name": "none"}, {"role": "button"}, {"role": "text", "name": "gone", "visible": False},
        {"role": "list", "children": [{"role": "text", "name": "one"}, {"role": "text", "name": "two"}]}]}
    want = '[window] "Mail"\n  [button] "Send"\n  [slider] "4 | [CHECKED] | louder | URL: http://x"\n  [button]\n  [list]\n    [text] "one"\n    [text] "two"'
    assert clean(spark, {"data": tree, "is_browser": True}, {"data": [tree]}) == [("BROWSER", want), ("APP", want)]


def test_tree_special_roots(spark):
    two = [{"role": "a", "name": "one"}, {"role": "a", "name": "one"}]
    got = clean(spark, {"data": []}, {}, None, {"data": "text"}, {"data": {"is_pdf": True, "pdf_summary": {"text": "p" * 2000}}},
                {"data": two}, {"data": {"hidden": True, "name": "x"}}, {"data": {"k": 1}}, pdf_chars=1500)
    assert [g[0] for g in got] == ["EMPTY", "EMPTY", "EMPTY", "ERROR", "PDF", "APP", "APP", "APP"]
    assert got[4][1] == '[PDF] "' + "p" * 1500 + '"' and got[5][1] == '[VirtualRoot]\n  [a] "one"\n  [a] "one"'
    assert got[6][1] == "[Empty Tree]" and got[7][1] == "[Empty Tree]"


def test_tree_nodes_and_tokens(spark):
    raw = json.dumps({"data": {"role": "window", "title": "Top bar", "children": [{"role": "button", "name": "Save it"}, {"role": "text", "name": "secret", "hidden": True}]}})
    df = spark.createDataFrame([(raw,)], "raw string")
    got = df.select(F.explode(trees.snapshot_nodes(F.col("raw"))).alias("n")).select("n.*")
    assert rows(got) == [(0, "0", "window", "Top bar"), (1, "0.0", "button", "Save it")]
    t = df.select(trees.snapshot_tokens(F.col("raw")).alias("a"), trees.snapshot_tokens(F.col("raw"), True).alias("b")).first()
    assert "secret" in t["a"] and "secret" not in t["b"] and "it" in t["a"] and "it" not in t["b"]


def test_pdf_text_is_whole_by_default(spark):
    got = clean(spark, {"data": {"is_pdf": True, "pdf_summary": {"text": "p" * 2000}}})
    assert got == [("PDF", '[PDF] "' + "p" * 2000 + '"')]


def test_broken_and_deep_snapshots_stay_single_rows(spark):
    deep = '{"data": ' + '{"role": "group", "children": [' * 3000 + '{"role": "button", "name": "end"}' + "]}" * 3000 + "}"
    raw = [deep, "{bad", "[1]", None, json.dumps({"data": {"role": "button", "name": "Save"}})]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").coalesce(1)
    got = df.select("i", trees.clean_snapshot(F.col("raw")).alias("c"), trees.snapshot_tokens(F.col("raw")).alias("t"), trees.snapshot_broken(F.col("raw")).alias("b")).orderBy("i").collect()
    assert [r["c"]["type"] for r in got] == ["APP", "ERROR", "EMPTY", "EMPTY", "APP"]
    assert got[0]["c"]["accessibility"].endswith('[button] "end"') and "end" in got[0]["t"]
    assert [r["t"] for r in got[1:4]] == [[], [], []] and [r["b"] for r in got[1:]] == [True, True, False, False]
