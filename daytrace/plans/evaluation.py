"""Keyed evaluation, framed on ``embeddings``: user = label div 2, even labels are candidates, odd ones references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from daytrace.operators import runs as rn
from daytrace.plans.registry import query, r6, table
from daytrace.plans.vectors import V, vectors

LOW, HIGH, ONE_TO_ONE, JUDGE = 0.15, 0.40, 0.20, 0.30
SUBSETS = ["ax", "screen", "ax+metadata", "ax+metadata+ocr+screen"]
GATE, GATE_WINDOW = 0.25, 200
MODALITY = ["ax", "metadata", "ocr", "screen"]
EXACT = ["semantic_jaccard", "profile_jaccard"]


def metric_columns(names, digits: int = 4):
    return [r6(c, c, digits) for c in names]


# the metrics of every run (columns of ``on``) from its two sides: c(on…, id, text, vec) and r(on…, id, text, vec)
def metrics_sql(on: str, first: str = "i", second: str = "j") -> str:
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in on.split(", "))
    a_on = ", ".join(f"a.{k}" for k in on.split(", "))
    join = lambda t, u: f"{t} a JOIN {u} b ON {same}"
    return f"""x AS MATERIALIZED (SELECT {a_on}, a.id AS i, b.id AS j, list_dot_product(a.vec, b.vec) AS cos FROM {join('c', 'r')}),
bi AS (SELECT {on}, i, max(cos) AS m FROM x GROUP BY {on}, i), bj AS (SELECT {on}, j, max(cos) AS m FROM x GROUP BY {on}, j),
si AS (SELECT {on}, avg(m) AS s, count(*) AS nc, count(*) FILTER (m >= {JUDGE}) AS supported_count FROM bi GROUP BY {on}),
sj AS (SELECT {on}, avg(m) AS r, count(*) AS nr, count(*) FILTER (m >= {JUDGE}) AS covered_count FROM bj GROUP BY {on}),
es AS (SELECT {on}, list({{'a': [i], 'b': [j]}} ORDER BY cos DESC, {first} DESC, {second} DESC) AS es FROM x WHERE cos >= {ONE_TO_ONE} GROUP BY {on}),
g AS (SELECT {on}, list_reduce(es, lambda acc, n: CASE WHEN list_contains(acc.a, n.a[1]) OR list_contains(acc.b, n.b[1]) THEN acc
  ELSE {{'a': list_concat(acc.a, n.a), 'b': list_concat(acc.b, n.b)}} END) AS m FROM es),
z AS (SELECT {on}, 's' AS side, id, vec FROM c UNION ALL SELECT {on}, 'r', id, vec FROM r),
mu AS (SELECT {a_on}, a.side AS ps, a.id, b.side, least(greatest((list_dot_product(a.vec, b.vec) - {LOW}) / ({HIGH} - {LOW}), 0), 1) AS mu FROM {join('z', 'z')}),
pr AS (SELECT {on}, ps, id, sum(mu) AS dens, max(mu) FILTER (side = 's') AS ms, max(mu) FILTER (side = 'r') AS mr FROM mu GROUP BY {on}, ps, id),
co AS (SELECT {on}, sum(least(ms, mr) / greatest(dens, 1e-9)) AS i, sum(greatest(ms, mr) / greatest(dens, 1e-9)) AS u, sum(ms / greatest(dens, 1e-9)) AS vs, sum(mr / greatest(dens, 1e-9)) AS vr FROM pr GROUP BY {on}),
e AS (SELECT {on}, side, unnest(vec) AS y, unnest(range(1, len(vec) + 1)) AS p FROM z),
e2 AS (SELECT {on}, p, sum(y) FILTER (side = 's') AS ys, sum(y) FILTER (side = 'r') AS yr FROM e GROUP BY {on}, p),
wh AS (SELECT {on}, round(sum(ys * yr) / sqrt(sum(ys * ys)) / sqrt(sum(yr * yr)), 4) AS sem FROM e2 GROUP BY {on}),
tx AS (SELECT {on}, lower(text) AS t, bool_or(k = 0) AS ic, bool_or(k = 1) AS ir FROM (SELECT {on}, text, 0 AS k FROM c UNION ALL SELECT {on}, text, 1 FROM r) GROUP BY {on}, lower(text)),
tj AS (SELECT {on}, round(count(*) FILTER (ic AND ir) / count(*), 4) AS pj FROM tx GROUP BY {on}),
met AS (SELECT {a_on}, s, r, (s + r) / 2 AS sb, coalesce(len(m.a), 0) / (nc + nr - coalesce(len(m.a), 0)) AS sj, coalesce(i / nullif(u, 0), 0) AS soj, coalesce(i / nullif(vs, 0), 0) AS sp, coalesce(i / nullif(vr, 0), 0) AS sr,
  vs, vr, sem, pj, covered_count, supported_count, nc, nr FROM {join('si', 'sj').replace('sj b', 'sj b')} JOIN co ON {same.replace('b.', 'co.')} JOIN wh ON {same.replace('b.', 'wh.')} JOIN tj ON {same.replace('b.', 'tj.')} LEFT JOIN g ON {same.replace('b.', 'g.')}),
out AS (SELECT *, CASE WHEN sp + sr > 0 THEN 2 * sp * sr / (sp + sr) ELSE 0 END AS f1, 0.5 * sem + 0.3 * sj + 0.2 * sb AS comp FROM met)"""


SHOWN = """round(s, 4) AS source_to_reference_best_mean, round(r, 4) AS reference_to_source_best_mean, round(sb, 4) AS symmetric_best_mean, round(sj, 6) AS semantic_jaccard, round(soj, 4) AS soft_jaccard,
  round(sp, 4) AS soft_precision, round(sr, 4) AS soft_recall, round(f1, 4) AS soft_f1, round(vs, 3) AS soft_source_regions, round(vr, 3) AS soft_reference_regions,
  round(sem, 4) AS profile_semantic_similarity, pj AS profile_jaccard, round(comp, 4) AS profile_composite_score"""


def shown(df: DataFrame) -> list:
    near = [c for c in rn.METRICS if not c.endswith("regions") and c not in EXACT]
    return [*metric_columns(near), r6("semantic_jaccard", "semantic_jaccard"), *metric_columns(["soft_source_regions", "soft_reference_regions"], 3),
            *metric_columns(["profile_semantic_similarity", "profile_composite_score"]), "profile_jaccard"]


ROWS = f"""{V}, w AS (SELECT id, label, u AS usr, side, vec, 'T' || (id % 97) AS text, CASE WHEN u = 1 AND id % 4 = 3 THEN 'ax' ELSE ['ax', 'metadata', 'ocr', 'screen'][id % 4 + 1] END AS modality FROM v)"""


def statements(spark, sf) -> DataFrame:
    listed = F.element_at(F.array(*[F.lit(m) for m in MODALITY]), (F.col("id") % 4 + 1).cast("int"))
    return vectors(spark, sf).select(
        "user", "side", "label", "id", F.concat(F.lit("T"), (F.col("id") % 97).cast("string")).alias("text"), "vec", F.col("id").cast("double").alias("t"),
        F.when((F.col("user") == 1) & (F.col("id") % 4 == 3), "ax").otherwise(listed).alias("modality"))


SETS = " UNION ALL ".join(f"SELECT usr, '{s}' AS mods, id, text, vec FROM w WHERE side = 's' AND modality IN ({', '.join(repr(m) for m in s.split('+'))})" for s in SUBSETS)
E4_SQL = f"""WITH {ROWS}, cand AS ({SETS}),
seq AS (SELECT usr, mods, list([{{'id': id, 'vec': vec}}] ORDER BY id) AS s FROM cand GROUP BY usr, mods),
kept AS (SELECT usr, mods, list_reduce(s, lambda acc, n: CASE WHEN len(list_filter(acc, lambda k: n[1].id - k.id <= {GATE_WINDOW} AND list_dot_product(k.vec, n[1].vec) >= {GATE})) > 0 THEN acc ELSE list_concat(acc, n) END) AS ks FROM seq),
gated AS (SELECT usr, mods, unnest(list_transform(ks, lambda k: k.id)) AS id FROM kept),
c AS MATERIALIZED (SELECT 'none' AS arm, * FROM cand UNION ALL SELECT 'time_window_gate', cand.* FROM cand JOIN gated USING (usr, mods, id)),
runs AS (SELECT DISTINCT usr, mods, arm FROM c),
r AS MATERIALIZED (SELECT runs.arm, runs.usr, runs.mods, id, text, vec FROM w JOIN runs ON w.usr = runs.usr WHERE side = 'r'),
{metrics_sql("usr, mods, arm")},
users AS (SELECT DISTINCT n_nationkey % 7 AS usr FROM nation), subs AS (SELECT unnest({SUBSETS!r}) AS mods), arms AS (SELECT unnest(['none', 'time_window_gate']) AS arm),
cc AS (SELECT usr, mods, arm, count(*) AS n FROM c GROUP BY usr, mods, arm),
cm AS (SELECT usr, mods, count(*) AS n, {", ".join(f"count(*) FILTER (modality = '{m}') AS count_{m}" for m in MODALITY)} FROM (SELECT cand.usr, cand.mods, w.modality FROM cand JOIN w ON cand.id = w.id) GROUP BY usr, mods),
rc AS (SELECT usr, count(*) AS n FROM w WHERE side = 'r' GROUP BY usr)
SELECT users.usr AS "user", subs.mods, arms.arm, coalesce(rc.n, 0) AS ideal_count, coalesce(cm.n, 0) AS candidate_count, {", ".join(f"coalesce(count_{m}, 0) AS count_{m}" for m in MODALITY)}, coalesce(cc.n, 0) AS eval_count,
  CASE WHEN rc.n IS NULL THEN 'missing_ideal' WHEN cm.n IS NULL THEN 'empty_candidate' ELSE 'ok' END AS status, {SHOWN},
  covered_count, supported_count, round(covered_count / nr, 6) AS recall_rate, round(supported_count / nc, 6) AS precision_rate, nc * nr AS judge_pairs_total
FROM users CROSS JOIN subs CROSS JOIN arms LEFT JOIN rc ON rc.usr = users.usr LEFT JOIN cm ON cm.usr = users.usr AND cm.mods = subs.mods
LEFT JOIN cc ON cc.usr = users.usr AND cc.mods = subs.mods AND cc.arm = arms.arm LEFT JOIN out ON out.usr = users.usr AND out.mods = subs.mods AND out.arm = arms.arm"""


@query("e4_evaluated_runs", E4_SQL)
def evaluated_runs(spark, sf):
    rows = statements(spark, sf)
    users = table(spark, sf, "nation").select((F.col("n_nationkey") % 7).cast("long").alias("user")).distinct()
    arms = {"none": {}, "time_window_gate": {"threshold": GATE, "window": GATE_WINDOW}}
    out = rn.evaluate_subsets(
        rows.where("side = 's'"), rows.where("side = 'r'"), users, SUBSETS, arms, ["user"], threshold=ONE_TO_ONE, low=LOW, high=HIGH, judge_threshold=JUDGE)
    return out.select("user", "mods", "arm", "ideal_count", "candidate_count", *[f"count_{m}" for m in MODALITY], "eval_count", "status", *shown(out),
                      "covered_count", "supported_count", *metric_columns(["recall_rate", "precision_rate"], 6), "judge_pairs_total")


# E6: model of a statement = its label; the baseline is label 2u, the folders are labels 2u + 1 and, by residue, parts of them;
# user 3 has no baseline file, user 4 no folder, one folder of every user no file
E6_SQL = f"""WITH {ROWS}, users AS (SELECT DISTINCT n_nationkey % 7 AS usr FROM nation), base AS (SELECT usr FROM users WHERE usr < 5),
folders AS (SELECT usr, 'q' || k AS ref, k FROM users, range(4) AS t(k) WHERE usr NOT IN (4, 5)),
st AS (SELECT usr, 'q' || (id % 3) AS ref, id, text, vec FROM w WHERE side = 'r'),
ok AS (SELECT usr, ref FROM folders WHERE usr < 3 AND k < 3),
c AS MATERIALIZED (SELECT ok.usr, ok.ref, id, text, vec FROM ok JOIN w ON ok.usr = w.usr WHERE side = 's'),
r AS MATERIALIZED (SELECT ok.usr, ok.ref, id, text, vec FROM ok JOIN st ON ok.usr = st.usr AND ok.ref = st.ref),
{metrics_sql("usr, ref")}
SELECT users.usr AS "user", folders.ref AS reference_model, CASE WHEN folders.ref IS NULL THEN 'missing_qwen_input' WHEN users.usr >= 3 OR folders.k = 3 THEN 'missing_input' ELSE 'ok' END AS status,
  coalesce(nc, 0) AS source_count, coalesce(nr, 0) AS reference_count, {SHOWN} FROM users LEFT JOIN folders ON folders.usr = users.usr LEFT JOIN out ON out.usr = folders.usr AND out.ref = folders.ref"""


@query("e6_p6_baseline_rows", E6_SQL)
def baseline_rows(spark, sf):
    rows = statements(spark, sf)
    users = table(spark, sf, "nation").select((F.col("n_nationkey") % 7).cast("long").alias("user")).distinct()
    model = F.when(F.col("side") == "s", "gpt").otherwise(F.concat(F.lit("q"), (F.col("id") % 3).cast("string")))
    baselines = users.where("user < 5").select("user", F.lit("gpt").alias("source_model"), F.when(F.col("user") != 3, "file").alias("source_file"))
    folders = users.where("user not in (4, 5)").select("user", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select(
        "user", F.concat(F.lit("q"), F.col("k").cast("string")).alias("reference_model"), F.lit("ax").alias("mode"), F.when(F.col("k") < 3, "file").alias("reference_file"))
    out = rn.compare_with_baseline(users, baselines, folders, rows.withColumn("model", model), ["user"], threshold=ONE_TO_ONE, low=LOW, high=HIGH)
    return out.select("user", "reference_model", "status", "source_count", "reference_count", *shown(out))
