"""Run reports and agreement, framed on ``orders ⋈ customer``: user = nation, model = priority, method =
status, modality subset from the market segment, metric = scaled price."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from daytrace.operators import evaluate as ev
from daytrace.operators import report as rp
from daytrace.plans.registry import query, r6, table
from daytrace.session import cut

SUBSETS = {
    "BUILDING": "ax", "AUTOMOBILE": "metadata", "MACHINERY": "ax+metadata", "HOUSEHOLD": "ocr", "FURNITURE": "ax+ocr",
}
METHODS = {"O": "none", "F": "moving_window", "P": "rerank_cluster"}

_CASE_S = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUBSETS.items()) + " ELSE 'screen' END"
_CASE_M = "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METHODS.items()) + " END"
# Two runs of a cell differ by month, so that cells hold several runs; nation 0 has no 'ok' run of method none.
RUNS = f"""runs AS (SELECT CAST(c_nationkey AS BIGINT) AS u, o_orderpriority AS model, {_CASE_M} AS method, {_CASE_S} AS modalities,
  CASE WHEN c_nationkey = 0 AND o_orderstatus = 'O' THEN 'empty_candidate' ELSE 'ok' END AS status,
  count(*) AS candidate_count, count(*) FILTER (o_totalprice > 250000) AS eval_count, avg(o_totalprice) / 500000 AS f1_score
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4, 5),
ok AS (SELECT *, CASE WHEN eval_count = 0 THEN candidate_count ELSE eval_count END AS size FROM runs WHERE status = 'ok')"""


def runs(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    subset = F.expr(_CASE_S)
    status = F.when((F.col("c_nationkey") == 0) & (F.col("o_orderstatus") == "O"), "empty_candidate").otherwise("ok")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(
            F.col("c_nationkey").cast("bigint").alias("user"), F.col("o_orderpriority").alias("model"),
            F.expr(_CASE_M).alias("method"), subset.alias("modalities"), status.alias("status"))
        .agg(
            F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.col("o_totalprice") > 250000).alias("eval_count"),
            (F.avg("o_totalprice") / 500000).alias("f1_score"))
    )


def ok_runs(spark, sf) -> DataFrame:
    out = runs(spark, sf).where("status = 'ok'")
    return out.withColumn("size", F.when(F.col("eval_count") == 0, F.col("candidate_count")).otherwise(F.col("eval_count")))


@query("r1_comparison_table", f"""WITH {RUNS} SELECT u AS "user", modalities, model, method, status, candidate_count, CASE WHEN eval_count = 0 THEN candidate_count ELSE eval_count END AS eval_count,
  round(f1_score, 6) AS f1_score FROM runs ORDER BY 1, 2, 3""")
def comparison(spark, sf):
    out = rp.comparison_table(runs(spark, sf), ["none", "rerank_cluster", "moving_window"])
    return out.select("user", "modalities", "model", "method", "status", "candidate_count", "eval_count", r6("f1_score", "f1_score"))


@query("o3_report_order", f"""WITH {RUNS}, k AS (SELECT DISTINCT modalities, method, len(string_split(modalities, '+')) AS n,
  list_transform(string_split(modalities, '+'), lambda m: coalesce(list_position(['ax','metadata','ocr','screen'], m), 0)) AS p,
  list_position(['none','rerank_cluster','moving_window'], method) AS mo FROM runs)
SELECT modalities, method, row_number() OVER (ORDER BY n, p, mo) AS place FROM k""")
def report_order(spark, sf):
    from pyspark.sql import Window

    cells = runs(spark, sf).select("modalities", "method").distinct()
    order = [*rp.subset_order(F.col("modalities")), rp.method_order(F.col("method"), ["none", "rerank_cluster", "moving_window"])]
    return cells.select("modalities", "method", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("a15_two_level_mean", f"""WITH {RUNS}, a AS (SELECT modalities, method, u, avg(f1_score) AS f, avg(size) AS s, count(*) AS n FROM ok GROUP BY 1, 2, 3)
SELECT modalities, method, round(avg(f), 6) AS f1_score, round(avg(s), 6) AS size, CAST(sum(n) AS BIGINT) AS runs FROM a GROUP BY 1, 2""")
def two_level(spark, sf):
    out = rp.two_level_mean(ok_runs(spark, sf), ["modalities", "method"], "user", ["f1_score", "size"])
    return out.select("modalities", "method", r6("f1_score", "f1_score"), r6("size", "size"), "runs")


T95 = "[" + ", ".join(str(t) for t in rp.T95) + "]"
CELLS = f"""pm AS (SELECT modalities, method, model, avg(f1_score) AS v, avg(size) AS s FROM ok GROUP BY 1, 2, 3),
cell AS (SELECT modalities, method, count(*) AS n_models, avg(v) AS mean, avg(s) AS size,
  CASE WHEN count(*) >= 2 THEN CASE WHEN count(*) - 1 <= 30 THEN list_extract({T95}, count(*) - 1) ELSE 1.96 END * stddev_samp(v) / sqrt(count(*)) END AS ci FROM pm GROUP BY 1, 2)"""


@query("a16_cells_with_ci", f"""WITH {RUNS}, {CELLS} SELECT modalities, method, n_models, round(mean, 6) AS mean, round(coalesce(ci, -1), 6) AS ci, round(size, 6) AS size FROM cell""")
def cells(spark, sf):
    out = rp.cells(ok_runs(spark, sf), "f1_score", "size")
    return out.select("modalities", "method", "n_models", r6("mean", "mean"), r6(F.coalesce("ci", F.lit(-1.0)), "ci"), r6("size", "size"))


@query("a19_pivot", f"""WITH {RUNS}, {CELLS} SELECT modalities, round(coalesce(max(mean) FILTER (method = 'none'), -1), 6) AS none,
  round(coalesce(max(mean) FILTER (method = 'moving_window'), -1), 6) AS moving_window,
  round(coalesce(max(mean) FILTER (method = 'rerank_cluster'), -1), 6) AS rerank_cluster FROM cell GROUP BY modalities""")
def pivot(spark, sf):
    out = rp.pivot_table(rp.cells(ok_runs(spark, sf), "f1_score", "size"), ["none", "moving_window", "rerank_cluster"])
    return out.select("modalities", *[r6(F.coalesce(c, F.lit(-1.0)), c) for c in ("none", "moving_window", "rerank_cluster")])


@query("a19_footer", f"""WITH {RUNS}, {CELLS}, m AS (SELECT method, avg(mean) AS mean, avg(size) AS size FROM cell GROUP BY method)
SELECT method, round(mean, 6) AS mean, round(size, 6) AS size, round((mean - (SELECT mean FROM m WHERE method = 'none')) / (SELECT mean FROM m WHERE method = 'none') * 100, 4) AS vs_base_percent FROM m""")
def footer(spark, sf):
    out = rp.table_footer(rp.cells(ok_runs(spark, sf), "f1_score", "size"))
    return out.select("method", r6("mean", "mean"), r6("size", "size"), r6("vs_base_percent", "vs_base_percent", 4))


@query("w11_marks", f"""WITH {RUNS}, {CELLS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY method ORDER BY round(mean, 3) DESC) AS k FROM cell),
l AS (SELECT *, max(k) OVER (PARTITION BY method) AS n FROM r)
SELECT modalities, method, CASE WHEN k = 1 AND n > 1 THEN 'best' WHEN k = 2 AND n > 2 THEN 'second' ELSE '' END AS mark FROM l""")
def marks(spark, sf):
    out = rp.mark_cells(rp.cells(ok_runs(spark, sf), "f1_score", "size"), "method")
    return out.select("modalities", "method", F.coalesce("mark", F.lit("")).alias("mark"))


@query("r2_paired_cells", f"""WITH {RUNS}, k AS (SELECT u, model, modalities FROM ok GROUP BY 1, 2, 3 HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM ok)),
p AS (SELECT ok.* FROM ok JOIN k USING (u, model, modalities)), pm AS (SELECT modalities, method, model, avg(f1_score) AS v FROM p GROUP BY 1, 2, 3)
SELECT modalities, method, count(*) AS n_models, round(avg(v), 6) AS mean FROM pm GROUP BY 1, 2""")
def paired(spark, sf):
    out = rp.cells(rp.paired_runs(ok_runs(spark, sf)), "f1_score", "size")
    return out.select("modalities", "method", "n_models", r6("mean", "mean"))


@query("j11_runs_under_every_method", f"""WITH {RUNS} SELECT u AS "user", model, modalities FROM ok GROUP BY 1, 2, 3 HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM ok)""")
def every_method(spark, sf):
    return rp.paired_runs(ok_runs(spark, sf)).select("user", "model", "modalities").distinct()


@query("j10_native_over_reduced", f"""WITH {RUNS}, c AS (SELECT *, CASE WHEN u % 3 = 0 THEN 0 WHEN u % 3 = 1 THEN NULL ELSE candidate_count END AS count_metadata FROM ok),
p AS (SELECT u, model, method, list_filter(string_split(modalities, '+'), lambda m: NOT (m = 'metadata' AND coalesce(count_metadata, 1) = 0)) AS present, len(string_split(modalities, '+')) AS asked FROM c),
q AS (SELECT u, model, method, array_to_string(present, '+') AS modalities, len(present) = asked AS native FROM p WHERE len(present) > 0),
n AS (SELECT DISTINCT u, model, method, modalities FROM q WHERE native)
SELECT u AS "user", model, method, modalities, CAST(native AS INT) AS native FROM q WHERE native OR NOT EXISTS (SELECT 1 FROM n WHERE n.u = q.u AND n.model = q.model AND n.method = q.method AND n.modalities = q.modalities)""")
def native_runs(spark, sf):
    kind = F.col("user") % 3
    count = F.when(kind == 0, 0).when(kind == 2, F.col("candidate_count"))
    out = rp.resolve_runs(ok_runs(spark, sf).withColumn("count_metadata", count))
    return out.select("user", "model", "method", "modalities", F.col("native").cast("int").alias("native"))


@query("a20_distinct_counts", f"""WITH {RUNS} SELECT modalities, count(DISTINCT model) AS models, count(DISTINCT u) AS sessions FROM ok GROUP BY 1""")
def distinct_counts(spark, sf):
    return ok_runs(spark, sf).groupBy("modalities").agg(F.count_distinct("model").alias("models"), F.count_distinct("user").alias("sessions"))


@query("a21_subset_expansion", """WITH s AS (SELECT unnest(['en','de','fr','es','en+de','en+fr','de+fr','en+de+fr+es']) AS mods),
h AS (SELECT source, list(DISTINCT lang) AS have FROM documents GROUP BY source)
SELECT d.source, s.mods, count(*) AS n, round(avg(length(text)), 4) AS mean_chars FROM documents d JOIN h USING (source) JOIN s ON list_contains(string_split(s.mods, '+'), d.lang)
WHERE len(list_filter(string_split(s.mods, '+'), lambda m: NOT list_contains(have, m))) = 0 GROUP BY 1, 2""")
def subset_expansion(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang", F.length("text").alias("chars"))
    sets = ["en", "de", "fr", "es", "en+de", "en+fr", "de+fr", "en+de+fr+es"]
    out = rp.expand_subsets(docs, sets, ["source"], modality="lang")
    return out.groupBy("source", "mods").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("chars"), "mean_chars", 4))


@query("a22_all_slices", f"""WITH {RUNS} SELECT coalesce(CAST(u AS VARCHAR), 'all') AS "user", coalesce(model, 'all') AS model, coalesce(method, 'all') AS method,
  round(avg(f1_score), 6) AS f1_score, count(*) AS runs FROM ok GROUP BY CUBE (u, model, method)""")
def all_slices(spark, sf):
    out = rp.slices(ok_runs(spark, sf), ["user", "model", "method"], "f1_score")
    return out.select("user", "model", "method", r6("f1_score", "f1_score"), "runs")


PTS = f"""pts AS (SELECT model, u, method, avg(size) AS x, avg(f1_score) AS y FROM ok GROUP BY 1, 2, 3),
fr AS (SELECT * FROM pts p WHERE NOT EXISTS (SELECT 1 FROM pts q WHERE q.model = p.model AND q.x <= p.x AND q.y >= p.y AND (q.x < p.x OR q.y > p.y)))"""


def points(spark, sf) -> DataFrame:
    return ok_runs(spark, sf).groupBy("model", "user", "method").agg(F.avg("size").alias("x"), F.avg("f1_score").alias("y"))


@query("j15_frontier", f"""WITH {RUNS}, {PTS} SELECT model, u AS "user", method, round(x, 6) AS x, round(y, 6) AS y FROM fr""")
def front(spark, sf):
    return rp.frontier(points(spark, sf), keys=["model"]).select("model", "user", "method", r6("x", "x"), r6("y", "y"))


@query("w12_knee", f"""WITH {RUNS}, {PTS}, e AS (SELECT model, min(log10(x)) AS x0, max(log10(x)) AS x1, min(y) AS y0, max(y) AS y1 FROM fr GROUP BY model),
g AS (SELECT fr.*, coalesce((y - y0) / nullif(y1 - y0, 0), 0) - coalesce((log10(x) - x0) / nullif(x1 - x0, 0), 0) AS gap FROM fr JOIN e USING (model)),
k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(gap, 9) DESC, x) AS r FROM g)
SELECT model, u AS "user", method, round(x, 6) AS x, round(y, 6) AS y FROM k WHERE r = 1""")
def knee(spark, sf):
    out = rp.knee(rp.frontier(points(spark, sf), keys=["model"]), keys=["model"])
    return out.select("model", "user", "method", r6("x", "x"), r6("y", "y"))


@query("a17_frontier_fit", f"""WITH {RUNS}, {PTS}, s AS (SELECT model, count(*) AS n, avg(y) AS my, avg(log10(x)) AS mx,
  CASE WHEN var_pop(log10(x)) > 0 THEN regr_slope(y, log10(x)) ELSE 0 END AS slope,
  CASE WHEN var_pop(log10(x)) > 0 AND var_pop(y) > 0 THEN regr_r2(y, log10(x)) ELSE -1 END AS r2 FROM fr GROUP BY model)
SELECT model, n, round(slope, 5) AS slope, round(my - slope * mx, 5) AS intercept, round(r2, 4) AS r2 FROM s""")
def fit(spark, sf):
    out = rp.fit_line(rp.frontier(points(spark, sf), keys=["model"]), keys=["model"])
    return out.select("model", "n", r6("slope", "slope", 5), r6("intercept", "intercept", 5), r6(F.coalesce("r2", F.lit(-1.0)), "r2", 4))


@query("r4_quality_points", f"""WITH {RUNS}, a AS (SELECT modalities, method, u, avg(f1_score) AS f, avg(size) AS s, count(*) AS n FROM ok GROUP BY 1, 2, 3),
p AS (SELECT modalities, method, avg(s) AS x, avg(f) AS y, CAST(sum(n) AS BIGINT) AS runs FROM a GROUP BY 1, 2)
SELECT modalities, method, round(x, 6) AS x, round(y, 6) AS y, runs, CAST(NOT EXISTS (SELECT 1 FROM p q WHERE q.x <= p.x AND q.y >= p.y AND (q.x < p.x OR q.y > p.y)) AS INT) AS on_frontier FROM p""")
def quality(spark, sf):
    pts = cut(rp.quality_points(ok_runs(spark, sf), "size", "f1_score"))
    edge = rp.frontier(pts).select("modalities", "method", F.lit(1).alias("on_frontier"))
    out = pts.join(edge, ["modalities", "method"], "left")
    return out.select("modalities", "method", r6("x", "x"), r6("y", "y"), "runs", F.coalesce("on_frontier", F.lit(0)).alias("on_frontier"))


@query("r3_modality_summary", f"""WITH {RUNS}, p AS (SELECT modalities, u, avg(f1_score) AS v FROM ok GROUP BY 1, 2),
m AS (SELECT modalities, avg(v) AS mean, max(v) - min(v) AS spread, count(*) AS sessions FROM p GROUP BY 1)
SELECT modalities, round(mean, 6) AS mean, round(spread, 6) AS spread, sessions, CAST(mean = (SELECT max(mean) FROM m) AS INT) AS is_best,
  CAST(mean = (SELECT min(mean) FROM m) AS INT) AS is_weakest, CAST(spread = (SELECT max(spread) FROM m) AS INT) AS is_least_stable FROM m""")
def modality_summary(spark, sf):
    out = rp.modality_summary(ok_runs(spark, sf), "f1_score")
    flags = [F.col(c).cast("int").alias(c) for c in ("is_best", "is_weakest", "is_least_stable")]
    return out.select("modalities", r6("mean", "mean"), r6("spread", "spread"), "sessions", *flags)


@query("w13_best_run", f"""WITH {RUNS} SELECT u AS "user", model, method, modalities, CAST(f1_score = max(f1_score) OVER (PARTITION BY u, model) AS INT) AS is_best FROM ok""")
def best_run(spark, sf):
    out = rp.best_run_flag(ok_runs(spark, sf))
    return out.select("user", "model", "method", "modalities", F.col("is_best").cast("int").alias("is_best"))


@query("p9_kept_fraction", f"""WITH {RUNS} SELECT u AS "user", model, method, modalities, round(eval_count / candidate_count, 6) AS keep FROM runs""")
def keep(spark, sf):
    out = runs(spark, sf).withColumn("keep", rp.kept_fraction(F.col("eval_count"), F.col("candidate_count")))
    return out.select("user", "model", "method", "modalities", r6("keep", "keep"))


@query("o4_score_listing", f"""WITH {RUNS} SELECT u AS "user", model, method, modalities, round(f1_score, 6) AS f1_score, round(f1_score, 6) >= 0.4 AS fair FROM ok ORDER BY f1_score DESC""")
def listing(spark, sf):
    out = ok_runs(spark, sf).orderBy(F.desc("f1_score"))
    return out.select("user", "model", "method", "modalities", r6("f1_score", "f1_score"), (F.round("f1_score", 6) >= 0.4).alias("fair"))


# Agreement and profiles -------------------------------------------------------------------------------

@query("a11_a12_agreement", """WITH n AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS INT)) AS po, avg(quality) AS q, avg(toxic) AS t, (avg(quality) + avg(toxic)) / 2 AS m FROM labels)
SELECT n, round(po, 6) AS observed, round((po - (q * t + (1 - q) * (1 - t))) / (1 - (q * t + (1 - q) * (1 - t))), 6) AS kappa,
  round((po - 2 * m * (1 - m)) / (1 - 2 * m * (1 - m)), 6) AS ac1 FROM n""")
def agreement(spark, sf):
    out = ev.rater_agreement(table(spark, sf, "labels"), "quality", "toxic")
    return out.select("n", r6("observed", "observed"), r6("kappa", "kappa"), r6("ac1", "ac1"))


@query("e9_rater_pairs", """WITH l AS (SELECT doc_id AS item, 'quality' AS rater, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels
  UNION ALL SELECT doc_id, 'long', CAST(n_chars > 1000 AS INT) FROM documents),
j AS (SELECT a.rater AS ra, b.rater AS rb, a.label AS x, b.label AS y FROM l a JOIN l b ON a.item = b.item AND a.rater <> b.rater),
n AS (SELECT ra, rb, count(*) AS n, avg(CAST(x = y AS INT)) AS po, avg(x) AS q, avg(y) AS t, (avg(x) + avg(y)) / 2 AS m FROM j GROUP BY 1, 2)
SELECT ra AS rater_a, rb AS rater_b, n, round(po, 6) AS observed, round((po - (q * t + (1 - q) * (1 - t))) / (1 - (q * t + (1 - q) * (1 - t))), 6) AS kappa,
  round((po - 2 * m * (1 - m)) / (1 - 2 * m * (1 - m)), 6) AS ac1 FROM n""")
def rater_pairs(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("item"), "quality", "toxic")
    rows = lab.unpivot("item", ["quality", "toxic"], "rater", "label")
    size = table(spark, sf, "documents").select(
        F.col("doc_id").alias("item"), F.lit("long").alias("rater"), (F.col("n_chars") > 1000).cast("int").alias("label"))
    out = ev.rater_pairs(rows.unionByName(size))
    return out.select("rater_a", "rater_b", "n", r6("observed", "observed"), r6("kappa", "kappa"), r6("ac1", "ac1"))


FIELDS = {"1-URGENT": "goals.short", "2-HIGH": "Skills.main", "3-MEDIUM": "interests", "4-NOT SPECIFIED": "other", "5-LOW": "traits"}
_CASE_F = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIELDS.items()) + " END"
# a profile = a region's customers of one segment; a field = a priority; its items = price steps and months of its orders
PROF = f"""f AS (SELECT r_name || '/' || c_mktsegment AS p, {_CASE_F} AS path, list(DISTINCT 'P' || CAST(floor(o_totalprice / 500) AS BIGINT) || ' W' || strftime(o_orderdate, '%Y-%m')) AS items
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
ps AS (SELECT DISTINCT p FROM f), pr AS (SELECT a.p AS a, b.p AS b FROM ps a JOIN ps b ON a.p < b.p AND split_part(a.p, '/', 1) = split_part(b.p, '/', 1)),
k AS (SELECT DISTINCT a, b, path FROM (SELECT a, b, path FROM pr JOIN f ON f.p = a UNION ALL SELECT a, b, path FROM pr JOIN f ON f.p = b)),
s AS (SELECT k.a, k.b, k.path, CASE WHEN x.items IS NULL OR y.items IS NULL THEN 0 ELSE len(list_intersect(x.items, y.items)) / len(list_distinct(list_concat(x.items, y.items))) END AS jaccard,
  CASE WHEN contains(lower(k.path), 'goals') THEN 0.25 WHEN contains(lower(k.path), 'skills') OR contains(lower(k.path), 'interests') THEN 0.20 ELSE 0.05 END AS weight
  FROM k LEFT JOIN f x ON x.p = k.a AND x.path = k.path LEFT JOIN f y ON y.p = k.b AND y.path = k.path)"""


def profile_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    item = F.concat(F.lit("P"), F.floor(F.col("o_totalprice") / 500).cast("string"), F.lit(" W"), F.date_format("o_orderdate", "yyyy-MM"))
    fields = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.concat_ws("/", "r_name", "c_mktsegment").alias("profile_id"), F.expr(_CASE_F).alias("path"))
        .agg(F.collect_set(item).alias("items"))
    )
    ids = fields.select(F.col("profile_id").alias("a"), F.split_part("profile_id", F.lit("/"), F.lit(1)).alias("_g")).distinct()
    pairs = ids.join(ids.select(F.col("a").alias("b"), "_g"), "_g").where("a < b").select("a", "b")
    return fields, pairs


@query("a8_j12_field_jaccard", f"""WITH {PROF} SELECT a, b, path, round(jaccard, 6) AS jaccard, CAST(weight AS DOUBLE) AS weight FROM s""")
def field_jaccard(spark, sf):
    fields, pairs = profile_tables(spark, sf)
    return ev.field_similarity(fields, pairs).select("a", "b", "path", r6("jaccard", "jaccard"), "weight")


@query("e7_a18_profile_similarity", f"""WITH {PROF}, t AS (SELECT a, b, sum(jaccard * weight) / sum(weight) AS w, avg(jaccard) AS j FROM s GROUP BY 1, 2),
wd AS (SELECT p, path, word, count(*) AS c FROM (SELECT p, path, unnest(string_split(lower(array_to_string(items, ' ')), ' ')) AS word FROM f) GROUP BY ALL),
wp AS (SELECT p, path, word, c / sqrt(sum(c * c) OVER (PARTITION BY p, path)) AS c FROM wd),
ww AS (SELECT p, word, c / sqrt(sum(c * c) OVER (PARTITION BY p)) AS c FROM (SELECT p, word, sum(c) AS c FROM wd GROUP BY p, word)),
cw AS (SELECT a, b, sum(x.c * y.c) AS semantic FROM pr JOIN ww x ON x.p = a JOIN ww y ON y.p = b AND y.word = x.word GROUP BY a, b),
cp AS (SELECT a, b, x.path, sum(x.c * y.c) AS cos FROM pr JOIN wp x ON x.p = a JOIN wp y ON y.p = b AND y.word = x.word AND y.path = x.path GROUP BY a, b, x.path),
am AS (SELECT k.a, k.b, avg(coalesce(cos, 0)) AS av FROM k LEFT JOIN cp ON cp.a = k.a AND cp.b = k.b AND cp.path = k.path GROUP BY k.a, k.b),
c AS (SELECT t.a, t.b, w, j, semantic, av, 0.5 * semantic + 0.3 * w + 0.2 * j AS total FROM t JOIN cw ON cw.a = t.a AND cw.b = t.b JOIN am ON am.a = t.a AND am.b = t.b)
SELECT a, b, round(w, 4) AS weighted_jaccard, round(j, 4) AS average_jaccard, round(semantic, 4) AS semantic_similarity, round(av, 4) AS average_semantic, round(total, 4) AS composite_score,
  CASE WHEN total >= 0.8 THEN 'Very High Similarity' WHEN total >= 0.6 THEN 'High Similarity' WHEN total >= 0.4 THEN 'Moderate Similarity' WHEN total >= 0.2 THEN 'Low Similarity' ELSE 'Very Low Similarity' END AS interpretation FROM c""")
def profile_similarity(spark, sf):
    fields, pairs = profile_tables(spark, sf)
    out = ev.profile_scores(ev.field_similarity(fields, pairs), ev.text_cosine(fields, pairs))
    return out.select("a", "b", *[r6(c, c, 4) for c in ("weighted_jaccard", "average_jaccard", "semantic_similarity", "average_semantic", "composite_score")], "interpretation")
