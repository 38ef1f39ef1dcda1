"""Similarity, merge arms and set scoring, framed on ``embeddings`` (user = label div 2, candidate side =
even labels, reference side = odd labels) and on ``documents`` for texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from daytrace.functions import vectors as vx
from daytrace.operators import evaluate as ev
from daytrace.operators import merge as mg
from daytrace.operators import report as rp
from daytrace.operators import similarity as sim
from daytrace.operators.infer import lexical_score
from daytrace.operators.ordered import Ordered, ordinal_chunk
from daytrace.plans.registry import query, r6, table

THETA = 0.35
LOW, HIGH = 0.15, 0.40
ONE_TO_ONE = 0.20
WINDOW = 50
GATE, GATE_WINDOW, DECAY = 0.25, 60, 400.0

V = """raw AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings),
v AS (SELECT id, label, label // 2 AS u, CASE WHEN label % 2 = 0 THEN 's' ELSE 'r' END AS side,
  list_transform(c, lambda x: CAST(CAST(x / sqrt(list_dot_product(c, c)) AS FLOAT) AS DOUBLE)) AS vec FROM raw)"""
CROSS = """x AS (SELECT a.u, a.id AS i, b.id AS j, list_dot_product(a.vec, b.vec) AS cos FROM v a JOIN v b ON a.u = b.u AND a.side = 's' AND b.side = 'r')"""


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit(0).alias("all"), F.expr("label div 2").alias("user"), "label",
        F.when(F.col("label") % 2 == 0, "s").otherwise("r").alias("side"), F.col("vec_id").alias("id"),
        vx.normalize(F.col("embedding")).alias("vec"))


def sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf)
    return v.where("side = 's'"), v.where("side = 'r'")


@query("f17_unit_vectors", f"""WITH {V} SELECT id, round(list_sum(vec), 5) AS total, round(list_dot_product(vec, vec), 5) AS norm2 FROM v""")
def unit(spark, sf):
    v = vectors(spark, sf)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return v.select("id", r6(total, "total", 5), r6(vx.dot(F.col("vec"), F.col("vec")), "norm2", 5))


@query("f18_cosine_to_centroid", f"""WITH {V}, e AS (SELECT id, label, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS p FROM v),
c AS (SELECT label, p, avg(x) AS m FROM e GROUP BY label, p), k AS (SELECT label, list(m ORDER BY p) AS mid FROM c GROUP BY label)
SELECT id, round(list_dot_product(vec, mid) / (sqrt(list_dot_product(vec, vec)) + 1e-9) / (sqrt(list_dot_product(mid, mid)) + 1e-9), 5) AS cosine
FROM v JOIN k ON v.label = k.label""")
def to_centroid(spark, sf):
    v = vectors(spark, sf)
    mids = sim.centroids(v, ["label"])
    return v.join(mids, "label").select("id", r6(1 - vx.cosine_distance(F.col("vec"), F.col("centroid")), "cosine", 5))


@query("j7_similar_pairs", f"""WITH {V} SELECT a.id AS i, b.id AS j, round(list_dot_product(a.vec, b.vec), 5) AS cos FROM v a JOIN v b ON a.id < b.id
WHERE list_dot_product(a.vec, b.vec) >= {THETA}""")
def similar_pairs(spark, sf):
    return sim.pairs_above(vectors(spark, sf), ["all"], THETA).select("i", "j", r6("cos", "cos", 5))


@query("j8_cross_pairs", f"""WITH {V}, {CROSS} SELECT u AS "user", i, j, round(cos, 5) AS cos FROM x WHERE cos >= {LOW}""")
def cross_pairs(spark, sf):
    s, r = sides(spark, sf)
    return sim.cross_pairs_above(s, r, ["user"], LOW).select("user", "i", "j", r6("cos", "cos", 5))


@query("a7_best_match_means", f"""WITH {V}, {CROSS}, a AS (SELECT u, avg(m) AS s FROM (SELECT u, i, max(cos) AS m FROM x GROUP BY u, i) GROUP BY u),
b AS (SELECT u, avg(m) AS r FROM (SELECT u, j, max(cos) AS m FROM x GROUP BY u, j) GROUP BY u)
SELECT a.u AS "user", round(s, 5) AS source_to_reference_best_mean, round(r, 5) AS reference_to_source_best_mean,
  round((s + r) / 2, 5) AS symmetric_best_mean FROM a JOIN b ON a.u = b.u""")
def best_means(spark, sf):
    s, r = sides(spark, sf)
    out = ev.best_match_means(s, r, ["user"])
    return out.select("user", *[r6(c, c, 5) for c in out.columns if c != "user"])


@query("j9_mutual_shortlist", f"""WITH {V}, {CROSS}, k AS (SELECT *, row_number() OVER (PARTITION BY u, i ORDER BY cos DESC, j DESC) AS ri,
  row_number() OVER (PARTITION BY u, j ORDER BY cos DESC, i DESC) AS rj FROM x)
SELECT u AS "user", i, j, round(cos, 5) AS cos FROM k WHERE ri <= 3 OR rj <= 3""")
def shortlist(spark, sf):
    s, r = sides(spark, sf)
    return ev.shortlist(s, r, ["user"], 3).select("user", "i", "j", r6("cos", "cos", 5))


@query("o2_top_matches", f"""WITH {V}, {CROSS}, k AS (SELECT *, row_number() OVER (PARTITION BY u, i ORDER BY cos DESC, j DESC) AS ri FROM x)
SELECT u AS "user", i, coalesce(string_agg(CAST(j AS VARCHAR), ',' ORDER BY ri) FILTER (cos >= 0.25), '') AS matched FROM k WHERE ri <= 3 GROUP BY u, i""")
def top_matches(spark, sf):
    s, r = sides(spark, sf)
    best = sim.top_matches(s, r, ["user"], k=3).where("side = 'left'")
    rows = ev.judge_rows(
        best.select("user", F.col("id").alias("i"), F.col("other").alias("j"), F.col("cos").alias("score")), ["user"], "i", "j", 0.25, 3)
    return rows.select("user", "i", F.array_join(F.col("matched_ids").cast("array<string>"), ",").alias("matched"))


@query("a9_soft_coverage", f"""WITH {V}, m AS (SELECT p.u, p.id, c.side, least(greatest((list_dot_product(p.vec, c.vec) - {LOW}) / ({HIGH} - {LOW}), 0), 1) AS mu
  FROM v p JOIN v c ON p.u = c.u),
g AS (SELECT u, id, sum(mu) AS dens, max(mu) FILTER (side = 's') AS ms, max(mu) FILTER (side = 'r') AS mr FROM m GROUP BY u, id),
t AS (SELECT u, sum(least(ms, mr) / greatest(dens, 1e-9)) AS i, sum(greatest(ms, mr) / greatest(dens, 1e-9)) AS un,
  sum(ms / greatest(dens, 1e-9)) AS s, sum(mr / greatest(dens, 1e-9)) AS r FROM g GROUP BY u)
SELECT u AS "user", round(i / un, 5) AS soft_jaccard, round(i / s, 5) AS soft_precision, round(i / r, 5) AS soft_recall,
  round(2 * (i / s) * (i / r) / (i / s + i / r), 5) AS soft_f1, round(s, 4) AS soft_source_regions, round(r, 4) AS soft_reference_regions FROM t""")
def soft(spark, sf):
    s, r = sides(spark, sf)
    out = ev.soft_coverage(s, r, ["user"], LOW, HIGH)
    return out.select("user", *[r6(c, c, 4 if c.endswith("regions") else 5) for c in out.columns if c != "user"])


@query("a9_soft_coverage_pool", f"""WITH {V}, m AS (SELECT c.u, p.id, c.side, least(greatest((list_dot_product(p.vec, c.vec) - {LOW}) / ({HIGH} - {LOW}), 0), 1) AS mu
  FROM v p JOIN v c ON p.u = c.u),
g AS (SELECT u, id, max(mu) FILTER (side = 's') AS ms, max(mu) FILTER (side = 'r') AS mr FROM m GROUP BY u, id),
t AS (SELECT u, sum(least(ms, mr)) AS i, sum(greatest(ms, mr)) AS un, sum(ms) AS s, sum(mr) AS r FROM g GROUP BY u)
SELECT u AS "user", round(i / un, 5) AS soft_jaccard, round(i / s, 5) AS soft_precision, round(i / r, 5) AS soft_recall,
  round(2 * (i / s) * (i / r) / (i / s + i / r), 5) AS soft_f1 FROM t""")
def soft_pool(spark, sf):
    s, r = sides(spark, sf)
    pool = vectors(spark, sf).select("user", "id", "vec")  # all statements of the user
    out = ev.soft_coverage(s, r, ["user"], LOW, HIGH, pool=pool)
    return out.select("user", *[r6(c, c, 5) for c in ("soft_jaccard", "soft_precision", "soft_recall", "soft_f1")])


E2_SQL = f"""WITH {V}, {CROSS}, e AS (SELECT u, list({{'a': [i], 'b': [j]}} ORDER BY cos DESC, i DESC, j DESC) AS es FROM x WHERE cos >= {ONE_TO_ONE} GROUP BY u),
g AS (SELECT u, list_reduce(es, lambda acc, n: CASE WHEN list_contains(acc.a, n.a[1]) OR list_contains(acc.b, n.b[1]) THEN acc
  ELSE {{'a': list_concat(acc.a, n.a), 'b': list_concat(acc.b, n.b)}} END) AS m FROM e),
n AS (SELECT u, count(*) FILTER (side = 's') AS ns, count(*) FILTER (side = 'r') AS nr FROM v GROUP BY u)
SELECT n.u AS "user", CAST(coalesce(len(m.a), 0) AS BIGINT) AS matched,
  round(coalesce(len(m.a), 0) / (ns + nr - coalesce(len(m.a), 0)), 6) AS semantic_jaccard FROM n LEFT JOIN g ON n.u = g.u"""


@query("e2_one_to_one_jaccard", E2_SQL)
def one_to_one(spark, sf):
    s, r = sides(spark, sf)
    return ev.one_to_one_jaccard(s, r, ["user"], ONE_TO_ONE).select("user", "matched", r6("semantic_jaccard", "semantic_jaccard"))


@query("e1_compare_sets", f"""WITH {V}, {CROSS}, n AS (SELECT u, count(*) FILTER (side = 's') AS ns, count(*) FILTER (side = 'r') AS nr FROM v GROUP BY u),
a AS (SELECT u, avg(m) AS s FROM (SELECT u, i, max(cos) AS m FROM x GROUP BY u, i) GROUP BY u),
b AS (SELECT u, avg(m) AS r FROM (SELECT u, j, max(cos) AS m FROM x GROUP BY u, j) GROUP BY u)
SELECT n.u AS "user", ns AS candidate_count, nr AS ideal_count, round((s + r) / 2, 5) AS symmetric_best_mean, 'ok' AS status FROM n JOIN a ON a.u = n.u JOIN b ON b.u = n.u""")
def compare(spark, sf):
    s, r = sides(spark, sf)
    out = ev.compare_sets(s, r, ["user"], ONE_TO_ONE, LOW, HIGH)
    return out.select("user", "candidate_count", "ideal_count", r6("symmetric_best_mean", "symmetric_best_mean", 5), "status")


@query("e3_a10_judge_summary", f"""WITH {V}, {CROSS}, a AS (SELECT u, i, max(cos) AS m FROM x GROUP BY u, i), b AS (SELECT u, j, max(cos) AS m FROM x GROUP BY u, j),
c AS (SELECT u, count(*) AS nr, count(*) FILTER (m >= 0.3) AS nc, avg(m) AS am FROM a GROUP BY u),
d AS (SELECT u, count(*) AS np, count(*) FILTER (m >= 0.3) AS ns, avg(m) AS bm FROM b GROUP BY u)
SELECT c.u AS "user", nr AS reference_count, nc AS covered_count, np AS prediction_count, ns AS supported_count, round(nc / nr, 6) AS recall_rate, round(ns / np, 6) AS precision_rate,
  round(CASE WHEN nc + ns > 0 THEN 2 * (nc / nr) * (ns / np) / (nc / nr + ns / np) ELSE 0 END, 6) AS f1_score,
  round(am, 5) AS mean_best_ref_to_pred_score, round(bm, 5) AS mean_best_pred_to_ref_score FROM c JOIN d ON c.u = d.u""")
def judge(spark, sf):
    s, r = sides(spark, sf)
    _, _, out = ev.judge(s, r, ["user"], threshold=0.3, top_k=3)
    return out.select(
        "user", "reference_count", "covered_count", "prediction_count", "supported_count",
        *[r6(c, c) for c in ("recall_rate", "precision_rate", "f1_score")],
        *[r6(c, c, 5) for c in ("mean_best_ref_to_pred_score", "mean_best_pred_to_ref_score")])


@query("a6_e8_centroid_distances", f"""WITH {V}, e AS (SELECT id, label, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS p FROM v),
c AS (SELECT label, p, avg(x) AS m FROM e GROUP BY label, p), k AS (SELECT label, list(m ORDER BY p) AS mid FROM c GROUP BY label)
SELECT a.label AS a, b.label AS b, round(CASE WHEN a.label = b.label THEN 0 ELSE 1 - list_dot_product(a.mid, b.mid) / ((sqrt(list_dot_product(a.mid, a.mid)) + 1e-9) * (sqrt(list_dot_product(b.mid, b.mid)) + 1e-9)) END, 5) AS distance
FROM k a CROSS JOIN k b""")
def distances(spark, sf):
    return ev.centroid_distances(vectors(spark, sf), "label").select("a", "b", r6("distance", "distance", 5))


# Merge arms -------------------------------------------------------------------------------------------

COMP = """reach AS (SELECT DISTINCT {k}i AS s, j AS d FROM edges UNION SELECT {k}j, i FROM edges)"""
PASS1 = f"""w AS (SELECT *, id // {WINDOW} AS win FROM v),
edges AS (SELECT a.id AS i, b.id AS j FROM w a JOIN w b ON a.win = b.win AND a.id < b.id WHERE list_dot_product(a.vec, b.vec) >= {THETA}),
sym AS (SELECT i AS s, j AS d FROM edges UNION SELECT j, i FROM edges UNION SELECT id, id FROM v),
reach AS (SELECT s, d FROM sym UNION SELECT r.s, e.d FROM reach r JOIN sym e ON r.d = e.s),
comp AS (SELECT s AS id, min(d) AS cluster FROM reach GROUP BY s),
mem AS (SELECT v.id, v.vec, comp.cluster, v.id // {WINDOW} AS win FROM v JOIN comp ON v.id = comp.id),
cent AS (SELECT a.cluster, a.win, a.id, sum(list_dot_product(a.vec, b.vec)) AS c, count(*) AS size FROM mem a JOIN mem b ON a.cluster = b.cluster GROUP BY a.cluster, a.win, a.id),
mains AS (SELECT win, cluster, arg_max(id, {{'c': round(c, 9), 'n': -id}}) AS id, max(size) AS size FROM cent GROUP BY win, cluster)"""


def items(spark, sf) -> DataFrame:
    v = vectors(spark, sf)
    return v.select("all", "id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("text"), "vec", F.col("id").alias("t"))


@query("m4_window_clusters", f"""WITH RECURSIVE {V}, {PASS1} SELECT win, cluster, id AS medoid, size FROM mains""")
def window_clusters(spark, sf):
    rows = mg.tumbling(items(spark, sf), ["all"], WINDOW)
    out = mg.cluster_reduce(rows, ["all", "win"], THETA)
    return out.select("win", "cluster", F.col("id").alias("medoid"), "size")


@query("m5_moving_window", f"""WITH RECURSIVE {V}, {PASS1}, p AS (SELECT row_number() OVER (ORDER BY win, cluster) - 1 AS pos, mains.id, vec FROM mains JOIN v ON v.id = mains.id),
near AS (SELECT a.pos AS i, b.pos AS j, list_dot_product(a.vec, b.vec) AS cos FROM p a JOIN p b ON a.pos < b.pos WHERE list_dot_product(a.vec, b.vec) >= {THETA}),
nb AS (SELECT p.pos, coalesce((SELECT list(i) FROM near WHERE near.j = p.pos), []) AS ns FROM p),
run AS (SELECT CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT nb.pos, CASE WHEN len(list_intersect(nb.ns, run.kept)) > 0 THEN run.kept ELSE list_append(run.kept, nb.pos) END FROM run JOIN nb ON nb.pos = run.pos + 1),
kept AS (SELECT unnest(kept) AS pos FROM run WHERE pos = (SELECT max(pos) FROM p))
SELECT p.pos, p.id AS src_id, coalesce((SELECT arg_max(i, {{'c': cos, 'n': -i}}) FROM near WHERE j = p.pos AND i IN (SELECT pos FROM kept)), -1) AS absorbed_by FROM p""")
def moving_window(spark, sf):
    out = mg.moving_window(items(spark, sf), ["all"], WINDOW, THETA)
    return out.select("pos", "src_id", F.coalesce("into", F.lit(-1)).alias("absorbed_by"))


def observations(spark, sf) -> DataFrame:
    """One observation for each vector: summary and transcription of a pair of turns, taken in turn from all pairs."""
    talk = table(spark, sf, "conversations").groupBy("conv_id", F.expr("turn div 2").alias("pair_idx")).agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("summary"),
        F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("transcription"))
    placed = Ordered(talk.withColumn("all", F.lit(0)), ["all"], ["conv_id", "pair_idx"], ordinal_chunk("conv_id", 4_096)).ordinal("n").done().drop("all")
    v = vectors(spark, sf).crossJoin(F.broadcast(talk.agg(F.count(F.lit(1)).alias("_many"))))  # one row
    return v.withColumn("n", F.col("id") % F.col("_many")).join(placed, "n").select(
        "all", "id", "vec", F.element_at(F.array(*[F.lit(m) for m in ("ax", "metadata", "screen")]), F.col("label") % 3 + 1).alias("modality"),
        "pair_idx", F.col("id").cast("double").alias("start"), F.col("id").cast("double").alias("end"), "summary", "transcription")


OBSERVED = f"""pairs AS (SELECT row_number() OVER (ORDER BY conv_id, turn // 2) - 1 AS n, conv_id, turn // 2 AS pair_idx, max(text) FILTER (role = 'user') AS summary, coalesce(max(text) FILTER (role = 'assistant'), '') AS transcription FROM conversations GROUP BY conv_id, turn // 2),
obs AS (SELECT vec_id AS id, ['ax', 'metadata', 'screen'][label % 3 + 1] AS modality, pairs.* FROM embeddings JOIN pairs ON vec_id % (SELECT count(*) FROM pairs) = n WHERE regexp_replace(coalesce(summary, ''), '^\\s+|\\s+$', '', 'g') <> ''),
{V.replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT id FROM obs))")}"""


@query("m6_p5_p12_merged_modalities", f"""WITH RECURSIVE {OBSERVED}, {PASS1}
SELECT obs.id, obs.modality, obs.pair_idx AS source_pair_idx, CAST(obs.id AS DOUBLE) AS start, md5(regexp_replace(obs.summary, '^\\s+|\\s+$', '', 'g')) AS summary, md5(obs.transcription) AS transcription FROM mains JOIN obs ON obs.id = mains.id""")
def merged_modalities(spark, sf):
    out, _ = mg.merge_modalities(observations(spark, sf), ["all"], WINDOW, THETA, "summary", long_term=False)
    return out.select("id", "modality", "source_pair_idx", "start", F.md5("summary").alias("summary"), F.md5("transcription").alias("transcription"))


@query("a5_modality_counts", f"""WITH RECURSIVE {OBSERVED}, {PASS1}
SELECT obs.modality, count(*) AS observations, count(*) FILTER (regexp_replace(obs.transcription, '^\\s+|\\s+$', '', 'g') <> '') AS with_transcription, count(mains.id) AS kept FROM obs LEFT JOIN mains ON obs.id = mains.id GROUP BY obs.modality""")
def modality_counts(spark, sf):
    _, counts = mg.merge_modalities(observations(spark, sf), ["all"], WINDOW, THETA, "summary", long_term=False)
    return counts.drop("all")


def gate_sql(near: str) -> str:
    return f"""WITH RECURSIVE {V}, near AS ({near}),
nb AS (SELECT v.id AS pos, coalesce((SELECT list(i) FROM near WHERE near.j = v.id), []) AS ns FROM v),
run AS (SELECT CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT nb.pos, CASE WHEN len(list_intersect(nb.ns, run.kept)) > 0 THEN run.kept ELSE list_append(run.kept, nb.pos) END FROM run JOIN nb ON nb.pos = run.pos + 1),
kept AS (SELECT unnest(kept) AS pos FROM run WHERE pos = (SELECT max(id) FROM v))
SELECT v.id, coalesce((SELECT arg_max(i, {{'c': sim, 'n': -i}}) FROM near WHERE j = v.id AND i IN (SELECT pos FROM kept)), -1) AS absorbed_by FROM v"""


@query("m3_novelty_gate", gate_sql(f"""SELECT a.id AS i, b.id AS j, list_dot_product(a.vec, b.vec) AS sim FROM v a JOIN v b ON a.id < b.id
  WHERE b.id - a.id <= {GATE_WINDOW} AND list_dot_product(a.vec, b.vec) >= {GATE}"""))
def gate(spark, sf):
    out = mg.novelty_gate(items(spark, sf), ["all"], GATE, GATE_WINDOW)
    return out.select("id", F.coalesce("into", F.lit(-1)).alias("absorbed_by"))


@query("m3_novelty_gate_decay", gate_sql(f"""SELECT a.id AS i, b.id AS j, list_dot_product(a.vec, b.vec) * exp(-(b.id - a.id) / {DECAY}) AS sim FROM v a JOIN v b ON a.id < b.id
  WHERE list_dot_product(a.vec, b.vec) * exp(-(b.id - a.id) / {DECAY}) >= {GATE}"""))
def gate_decay(spark, sf):
    out = mg.novelty_gate(items(spark, sf), ["all"], GATE, None, decay=DECAY)
    return out.select("id", F.coalesce("into", F.lit(-1)).alias("absorbed_by"))


TAU = 0.02
TOKENS = """tok AS MATERIALIZED (SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1)) AS ts FROM documents)"""


@query("m2_rerank_clusters", f"""WITH RECURSIVE {V}, {TOKENS}, cand AS MATERIALIZED (SELECT a.id AS i, b.id AS j FROM v a JOIN v b ON a.id < b.id WHERE list_dot_product(a.vec, b.vec) >= {THETA}),
edges AS (SELECT i, j FROM cand JOIN tok x ON x.id = i JOIN tok y ON y.id = j
  WHERE len(list_intersect(x.ts, y.ts)) / nullif(len(list_distinct(list_concat(x.ts, y.ts))), 0) >= {TAU}),
sym AS (SELECT i AS s, j AS d FROM edges UNION SELECT j, i FROM edges UNION SELECT id, id FROM v),
reach AS (SELECT s, d FROM sym UNION SELECT r.s, e.d FROM reach r JOIN sym e ON r.d = e.s),
comp AS (SELECT s AS id, min(d) AS cluster FROM reach GROUP BY s),
mem AS (SELECT v.id, v.vec, comp.cluster FROM v JOIN comp ON v.id = comp.id),
cent AS (SELECT a.cluster, a.id, sum(list_dot_product(a.vec, b.vec)) AS c, count(*) AS size FROM mem a JOIN mem b ON a.cluster = b.cluster GROUP BY a.cluster, a.id)
SELECT cluster, arg_max(id, {{'c': round(c, 9), 'n': -id}}) AS medoid, max(size) AS size FROM cent GROUP BY cluster""")
def rerank_clusters(spark, sf):
    v = vectors(spark, sf)
    ends = F.broadcast(v.agg(F.min("id").alias("_from"), F.max("id").alias("_to")))  # one row
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").join(ends, F.col("id").between(F.col("_from"), F.col("_to")))
    rows = v.join(docs.select("id", "text"), "id", "left").na.fill("", ["text"]).select("all", "id", "text", "vec")
    out = mg.cluster_reduce(rows, ["all"], THETA, lexical_score, TAU)
    return out.select("cluster", F.col("id").alias("medoid"), "size")


@query("a25_merge_stats", f"""WITH RECURSIVE {V}, {PASS1} SELECT count(DISTINCT v.id) AS merge_input_count, (SELECT count(*) FROM mains) AS merge_output_count,
  (SELECT count(*) FROM mains WHERE size > 1) AS merge_clusters_reduced, count(DISTINCT v.id) - (SELECT count(*) FROM mains) AS merge_absorbed FROM v""")
def stats(spark, sf):
    rows = mg.tumbling(items(spark, sf), ["all"], WINDOW)
    out = mg.cluster_reduce(rows, ["all", "win"], THETA)
    return mg.merge_stats(rows, out, ["all"]).drop("all").select(
        "merge_input_count", "merge_output_count", "merge_clusters_reduced", "merge_absorbed")


@query("m7_arm_sizes", f"""WITH RECURSIVE {V}, {PASS1} SELECT 'none' AS arm, count(*) AS kept FROM v UNION ALL SELECT 'moving_window', count(*) FROM mains""")
def arm_sizes(spark, sf):
    rows = items(spark, sf)
    none = mg.run_arm(rows, ["all"], "none").withColumn("arm", F.lit("none"))
    win = mg.run_arm(rows, ["all"], "moving_window", size=WINDOW, theta=THETA, long_term=False).withColumn("arm", F.lit("moving_window"))
    return none.unionByName(win).groupBy("arm").agg(F.count(F.lit(1)).alias("kept"))


# Calibration ------------------------------------------------------------------------------------------

BINS = dict(low=0.0, width=0.1, bins=5, per_bin=40)
SAMPLE = f"""x AS (SELECT a.u, a.id AS i, b.id AS j, a.label = b.label AS same, list_dot_product(a.vec, b.vec) AS cos FROM v a JOIN v b ON a.u = b.u AND a.id < b.id),
b AS (SELECT *, CAST(floor(cos / 0.1) AS INT) AS bin, (i * 7919 + j * 104729) % 1000003 AS draw FROM x WHERE cos >= 0 AND cos < 0.5),
smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, bin ORDER BY draw, i, j) AS rn FROM b) WHERE rn <= 40)"""


def judged(spark, sf, pairs) -> DataFrame:
    """A pair matches when both vectors have one label."""
    lab = vectors(spark, sf).select("id", "label")
    return (
        pairs.join(lab.select(F.col("id").alias("i"), F.col("label").alias("_a")), "i")
        .join(lab.select(F.col("id").alias("j"), F.col("label").alias("_b")), "j")
        .withColumn("match", (F.col("_a") == F.col("_b")).cast("int")).drop("_a", "_b")
    )


def sampled(spark, sf) -> DataFrame:
    return judged(spark, sf, sim.binned_pairs(vectors(spark, sf), ["user"], **BINS))


DRAWS = 300
RANDOM = f"""n AS (SELECT u, count(*) AS n FROM v GROUP BY u), o AS (SELECT u, id, vec, row_number() OVER (PARTITION BY u ORDER BY id) - 1 AS ord FROM v),
e AS (SELECT u, n, unnest(range(1, {DRAWS + 1})) AS draw FROM n),
d AS (SELECT u, draw, CAST('0x' || left(md5(concat_ws(':', u, draw, 0, 'i')), 12) AS BIGINT) % n AS i,
  CAST('0x' || left(md5(concat_ws(':', u, draw, 0, 'j')), 12) AS BIGINT) % n AS j FROM e),
rnd AS (SELECT d.u, draw, i, j, list_dot_product(a.vec, b.vec) AS cos FROM d JOIN o a ON a.u = d.u AND a.ord = i JOIN o b ON b.u = d.u AND b.ord = j)"""


def drawn(spark, sf) -> DataFrame:
    v = Ordered(vectors(spark, sf), ["user"], ["id"], ordinal_chunk("id")).ordinal("ord").done()
    return ev.random_pairs(v, "user", DRAWS)


@query("o5_stratified_pairs", f"""WITH {V}, {SAMPLE} SELECT u AS "user", bin, i, j, round(cos, 5) AS cos FROM smp""")
def stratified(spark, sf):
    return sim.binned_pairs(vectors(spark, sf), ["user"], **BINS).select("user", "bin", "i", "j", r6("cos", "cos", 5))


@query("a13_match_curve", f"""WITH {V}, {SAMPLE}, g AS (SELECT coalesce(u, -1) AS u, bin, avg(CAST(same AS INT)) AS p, count(*) AS n FROM smp GROUP BY GROUPING SETS ((u, bin), (bin))),
k AS (SELECT u, unnest(range(5)) AS bin FROM (SELECT DISTINCT u FROM smp UNION ALL SELECT -1))
SELECT k.u AS "user", k.bin, round(coalesce(p, -1), 6) AS p_match, coalesce(n, 0) AS n_pairs FROM k LEFT JOIN g ON k.u = g.u AND k.bin = g.bin""")
def match_curve(spark, sf):
    out = ev.match_curve(sampled(spark, sf), "user", 5)
    return out.select(F.coalesce("user", F.lit(-1)).alias("user"), "bin", r6(F.coalesce("p_match", F.lit(-1.0)), "p_match"), "n_pairs")


@query("a14_background", f"""WITH {V}, x AS (SELECT a.u, list_dot_product(a.vec, b.vec) AS cos FROM v a JOIN v b ON a.u = b.u AND a.id < b.id)
SELECT coalesce(u, -1) AS "user", count(*) AS n, round(avg(cos), 5) AS mean, round(quantile_cont(cos, 0.5), 5) AS q50,
  round(quantile_cont(cos, 0.9), 5) AS q90, round(quantile_cont(cos, 0.95), 5) AS q95, round(quantile_cont(cos, 0.99), 5) AS q99 FROM x GROUP BY GROUPING SETS ((u), ())""")
def background(spark, sf):
    out = sim.pair_quantiles(vectors(spark, sf), "user", (0.5, 0.9, 0.95, 0.99))
    return out.select(
        F.coalesce("user", F.lit(-1)).alias("user"), "n", r6("mean", "mean", 5),
        *[r6(F.col("q")[i], f"q{n}", 5) for i, n in enumerate((50, 90, 95, 99))])


W9 = f"""g AS (SELECT bin, (bin + 0.5) * 0.1 AS c, avg(CAST(same AS INT)) AS p FROM smp GROUP BY bin),
e AS (SELECT bin, c, max(p) OVER (ORDER BY bin) AS e FROM g), l AS (SELECT *, lag(e) OVER (ORDER BY bin) AS e0, lag(c) OVER (ORDER BY bin) AS c0 FROM e)"""


def w9_sql(level: float) -> str:
    return f"""coalesce((SELECT max(c) FROM l WHERE e = {level}), (SELECT arg_min(CASE WHEN e0 IS NULL OR e = e0 THEN c ELSE c0 + ({level} - e0) / (e - e0) * (c - c0) END, c) FROM l WHERE e > {level}), (SELECT max(c) FROM l))"""


@query("w9_curve_crossing", f"""WITH {V}, {SAMPLE}, {W9} SELECT round({w9_sql(0.52)}, 5) AS crossing""")
def curve_crossing(spark, sf):
    curve = ev.match_curve(sampled(spark, sf), "user", 5).where("user is null")
    curve = curve.withColumn("centre", (F.col("bin") + 0.5) * 0.1).withColumn("one", F.lit(1))
    return ev.crossing(curve, ["one"], 0.52).select(r6("crossing", "crossing", 5))


@query("e5_calibrated_bounds", f"""WITH {V}, {RANDOM}, {SAMPLE}, {W9.replace("e AS (", "env AS (").replace("FROM e)", "FROM env)")},
gd AS (SELECT quantile_cont(cos, 0.9) AS background FROM rnd WHERE u IN (SELECT u FROM n WHERE n >= 50))
SELECT round(round_even(greatest({w9_sql(0.5)}, background) / 0.05, 0) * 0.05, 6) AS low, round(round_even({w9_sql(0.55)} / 0.05, 0) * 0.05, 6) AS high,
  round({w9_sql(0.5)}, 5) AS low_crossing, round({w9_sql(0.55)}, 5) AS high_crossing, round(background, 5) AS background FROM gd""")
def calibrated(spark, sf):
    bounds, _ = ev.calibrate_bounds(
        vectors(spark, sf), "user", lambda p: judged(spark, sf, p), drawn(spark, sf), low=0.0, width=0.1, bins=5,
        per_bin=40, low_level=0.5, high_level=0.55, min_items=50)
    return bounds.select(
        r6("low", "low"), r6("high", "high"), r6("low_crossing", "low_crossing", 5), r6("high_crossing", "high_crossing", 5),
        r6("background", "background", 5))


@query("o6_random_pairs", f"""WITH {V}, {RANDOM} SELECT u AS "user", draw, i, j, round(cos, 5) AS cos FROM rnd""")
def random_pairs(spark, sf):
    return drawn(spark, sf).select("user", "draw", "i", "j", r6("cos", "cos", 5))


@query("r5_projection")
def projection(spark, sf):
    out = rp.project_vectors(vectors(spark, sf), k=3)
    pts = out.select("id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"), F.col("xy")[2].alias("z"))
    return rp.rotate_3d(pts).select("id", r6("u", "u", 4), r6("v", "v", 4), r6("depth", "depth", 4))
