"""Composed inference stages with stand-in clients: observations of ``events``, profiles of ``documents`` by language."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, functions as F

from daytrace.functions import vectors as vx
from daytrace.operators import memory as mem
from daytrace.operators import observe as ob
from daytrace.operators import profiles as pf
from daytrace.operators.ordered import Ordered, ordinal_chunk
from daytrace.operators.pairs import pair_ranges
from daytrace.plans.registry import query, table, us
from daytrace.session import cut, scratch_path

HISTORY = 3


def capital_client():
    return lambda prompts: [p.upper() for p in prompts]


def tired_client():
    def answer(prompts: list[str]) -> list[str]:
        if any(p.endswith("7") for p in prompts):
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]

    return answer


@query("n11_observations", f"""WITH e AS (SELECT user_id, event_id, event_type || ' ' || event_id AS body, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
l AS (SELECT user_id, max(t) AS last FROM e GROUP BY user_id)
SELECT a.user_id, a.i // 2 AS pair_idx, upper('pair: ' || a.body || ' | ' || b.body) AS transcription,
  upper('summary: ' || coalesce((SELECT string_agg(h.body, ';' ORDER BY h.i) FROM e h WHERE h.user_id = a.user_id AND h.i < a.i AND h.i >= a.i - {HISTORY}), '') || ' > ' || b.body) AS summary,
  CAST(least(a.i, {HISTORY}) AS INTEGER) AS n_history, a.t AS start_us, coalesce(n.t, l.last) AS end_us
FROM e a JOIN e b ON b.user_id = a.user_id AND b.i = a.i + 1 JOIN l ON l.user_id = a.user_id LEFT JOIN e n ON n.user_id = a.user_id AND n.i = a.i + 2 WHERE a.i % 2 = 0""")
def observations(spark, sf):
    """The first run loses the pairs whose prompt its client cannot answer; the second asks for those only."""
    rows = table(spark, sf, "events").select("user_id", "event_id", us("ts").alias("t"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("body"))
    placed = cut(Ordered(rows, ["user_id"], ["t", "event_id"], F.struct(F.floor(F.col("t") / 86_400_000_000), ordinal_chunk("event_id"))).ordinal("idx").done())
    app = placed.select("user_id", F.col("idx").alias("ord"), F.col("t").alias("ts"))
    path = scratch_path(spark, "ledger")
    stage = lambda client: ob.observe(
        placed, ["user_id"], "idx", ["idx", "body"], path, client, lambda a, b: F.concat(F.lit("pair: "), a["body"], F.lit(" | "), b["body"]),
        lambda h, a, b: F.concat(F.lit("summary: "), F.array_join(F.transform(h, lambda p: p["body"]), ";"), F.lit(" > "), b["body"]),
        HISTORY, ranges=lambda pairs: pair_ranges(pairs, app, ["user_id"], "metadata"), name="idx", calls=1, chunks=16, wave=16)
    stage(tired_client)
    layer, _ = stage(capital_client)
    return layer.select("user_id", "pair_idx", "transcription", "summary", F.size("history_ids").alias("n_history"), F.col("start").alias("start_us"), F.col("end").alias("end_us"))


ENTRY = re.compile(r"- id: \d+\n  proposition: \"(.*?)\"\n  confidence: (\w+)\n  decay: \w+\n", re.S)


def profile_client():
    """Partial profiles name the confidences that occur and count words; merged ones unite and add."""

    def one(prompt: str) -> str:
        head, _, body = prompt.partition("\n")
        if head == "merge":
            seen = [json.loads(line) for line in body.split("\n")]
            skills = {s for p in seen for s in p["static_profile"]["background_knowledge_skills"]["skills"]}
            words = sum(int(p["dynamic_profile"]["behaviors"]["recent_tasks"][0]) for p in seen)
        else:
            found = ENTRY.findall(body)
            skills, words = {c for _, c in found}, sum(len(t.split(" ")) for t, _ in found)
        return json.dumps({"static_profile": {"background_knowledge_skills": {"skills": sorted(skills)}}, "dynamic_profile": {"behaviors": {"recent_tasks": [str(words)]}}})

    return lambda prompts: [one(p) for p in prompts]


@query("n9_user_profiles", """SELECT lang AS "user", string_agg(DISTINCT CAST(doc_id % 10 AS VARCHAR), ',' ORDER BY CAST(doc_id % 10 AS VARCHAR)) AS skills,
  CAST(sum(len(string_split(coalesce(text, ''), ' '))) AS VARCHAR) AS words, CAST(NULL AS VARCHAR) AS error FROM documents GROUP BY lang""")
def user_profiles(spark, sf):
    docs = table(spark, sf, "documents")
    rows = docs.select(F.col("lang").alias("user"), "doc_id", "text", (F.col("doc_id") % 10).alias("confidence"), (F.col("doc_id") % 7).alias("decay"))
    out = pf.generate_profiles(
        rows, ["user"], "doc_id", profile_client, lambda lines: F.concat(F.lit("first\n"), lines), lambda ps: F.concat(F.lit("merge\n"), F.array_join(ps, "\n")))
    return out.select(
        "user", F.array_join("profile.static_profile.background_knowledge_skills.skills", ",").alias("skills"),
        F.col("profile.dynamic_profile.behaviors.recent_tasks")[0].alias("words"), "error")


# Long-term store: statements are the suppliers' balances as strings of digits, a merge keeps the larger string ------------------------
STORE_THETA = 0.69


def larger_text_client():
    def one(prompt: str) -> str:
        return json.dumps({"merged_proposition": max(json.loads(prompt.partition("\n")[2])), "merge_type": "supersede"})

    return lambda prompts: [one(p) for p in prompts]


def digit_vector(text: Column) -> Column:
    counts = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.length(text) - F.length(F.replace(text, d.cast("string"), F.lit(""))))
    return vx.normalize(counts)


def digit_encoder():
    def one(text: str) -> np.ndarray:
        n = np.array([text.count(d) for d in "0123456789"], float)
        return (n / (np.sqrt(n @ n) or 1.0)).astype(np.float32)

    return lambda texts: [one(t) for t in texts]


@query("m5_t4_n5_rewritten_store", f"""WITH RECURSIVE s AS (SELECT s_nationkey AS u, CAST(CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS VARCHAR) AS text, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier),
c AS (SELECT *, list_transform(range(10), lambda d: CAST(length(text) - length(replace(text, CAST(d AS VARCHAR), '')) AS DOUBLE)) AS n FROM s),
m AS (SELECT u, pos, text, list_transform(n, lambda x: CAST(CAST(x / sqrt(list_dot_product(n, n)) AS FLOAT) AS DOUBLE)) AS vec FROM c),
run AS (SELECT DISTINCT u, CAST(-1 AS BIGINT) AS pos, CAST([] AS STRUCT(pos BIGINT, text VARCHAR, vec DOUBLE[])[]) AS store, CAST(NULL AS BIGINT) AS into_pos FROM m UNION ALL
  SELECT u, pos, CASE WHEN hit THEN list_transform(store, lambda e, i: CASE WHEN i = best AND text > e.text THEN {{'pos': e.pos, 'text': text, 'vec': vec}} ELSE e END)
    ELSE list_append(store, {{'pos': pos, 'text': text, 'vec': vec}}) END, CASE WHEN hit THEN store[best].pos END
  FROM (SELECT *, coalesce(list_max(sims) >= {STORE_THETA}, false) AS hit, list_position(sims, list_max(sims)) AS best
    FROM (SELECT m.u, m.pos, m.text, m.vec, run.store, list_transform(run.store, lambda e: list_dot_product(e.vec, m.vec)) AS sims FROM run JOIN m ON m.u = run.u AND m.pos = run.pos + 1))),
fin AS (SELECT u, arg_max(store, pos) AS store FROM run GROUP BY u), entries AS (SELECT u, unnest(store) AS e FROM fin), took AS (SELECT u, into_pos, count(*) AS n FROM run WHERE into_pos IS NOT NULL GROUP BY u, into_pos)
SELECT CAST(run.u AS INTEGER) AS "user", run.pos, run.into_pos AS "into", run.into_pos IS NULL AS kept, coalesce(entries.e.text, m.text) AS text,
  CASE WHEN run.into_pos IS NULL THEN coalesce(took.n, 0) + 1 END AS versions, CASE WHEN run.into_pos IS NULL THEN CASE WHEN took.n > 0 THEN 'supersede' ELSE 'refine' END END AS merge_type
FROM run JOIN m ON m.u = run.u AND m.pos = run.pos LEFT JOIN entries ON entries.u = run.u AND entries.e.pos = run.pos LEFT JOIN took ON took.u = run.u AND took.into_pos = run.pos""")
def rewritten_store(spark, sf):
    balance = F.round(F.abs("s_acctbal") * 100).cast("bigint").cast("string")
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("user"), "s_suppkey", balance.alias("text"))
    placed = Ordered(rows, ["user"], ["s_suppkey"], ordinal_chunk("s_suppkey")).ordinal("pos").done()
    mains = placed.select("user", "pos", "text", digit_vector(F.col("text")).alias("vec"))
    guess = mains.select("user", "pos", F.lit(None).cast("bigint").alias("into"))
    out = mem.roll_up(mains, guess, ["user"], STORE_THETA, larger_text_client, digit_vector, encode=digit_encoder)
    return out.select("user", "pos", "into", "kept", "text", "versions", "merge_type")
