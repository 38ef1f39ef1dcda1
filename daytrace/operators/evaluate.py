"""Scoring one set of statements against another: best match, one-to-one, soft coverage, judge rates,
profile similarity, rater agreement and threshold calibration.

Set inputs carry ``keys``, ``id`` (bigint), unit ``vec`` and, where noted, ``text``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from daytrace.functions import text as tx
from daytrace.functions import vectors as vx
from daytrace.functions.common import join_on
from daytrace.operators.matching import match_sets
from daytrace.operators.similarity import (
    BLOCK_ROWS, binned_pairs, centroids, collapse_copies, coverage_sums, pool_coverage, top_matches,
)
from daytrace.session import cut

# Fixed values -----------------------------------------------------------------------------------------
FIELD_WEIGHTS = [
    ("goals", 0.25), ("skills", 0.20), ("interests", 0.20), ("knowledge", 0.15),
    ("preferences", 0.10), ("background", 0.05), ("traits", 0.05),
]
DEFAULT_WEIGHT = 0.05
COMPOSITE_SETS = (0.5, 0.3, 0.2)  # semantic similarity, one-to-one Jaccard, symmetric best match
COMPOSITE_PROFILE = (0.5, 0.3, 0.2)  # semantic similarity, weighted Jaccard, average Jaccard
# ------------------------------------------------------------------------------------------------------


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return zero_if_null(F.try_divide(2 * p * r, p + r))


def best_match_means(source: DataFrame, reference: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean best cosine in both directions and their average, per key present on both sides."""
    best = top_matches(source, reference, keys, k=1, block_rows=block_rows)
    means = best.groupBy(*keys).agg(
        F.avg(F.when(F.col("side") == "left", F.col("cos"))).alias("source_to_reference_best_mean"),
        F.avg(F.when(F.col("side") == "right", F.col("cos"))).alias("reference_to_source_best_mean"),
    )
    return means.withColumn(
        "symmetric_best_mean",
        (F.col("source_to_reference_best_mean") + F.col("reference_to_source_best_mean")) / 2,
    )


def one_to_one_jaccard(
    source: DataFrame, reference: DataFrame, keys: Sequence[str], threshold: float, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Greedy one-to-one matches above ``threshold`` over the union of both sets.  Copies enter as one row
    with a count, so crowds of equal statements never form all their pairs; pairs are listed band by band (``match_sets``)."""
    keys = list(keys)
    always = F.lit(True)
    s_reps, _ = collapse_copies(source, keys, ["vec"], always)
    r_reps, _ = collapse_copies(reference, keys, ["vec"], always)
    matched = match_sets(s_reps, r_reps, keys, threshold, block_rows=block_rows).groupBy(*keys).agg(F.sum("m").alias("matched"))
    n = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    m = reference.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    both = n.join(m, keys).join(matched, keys, "left").na.fill(0, ["matched"])
    return both.select(
        *keys, F.col("matched").cast("bigint").alias("matched"),
        zero_if_null(F.try_divide(F.col("matched").cast("double"), F.col("_n") + F.col("_m") - F.col("matched"))).alias("semantic_jaccard"),
    )


def _coverage_rates(sums: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    w = weight
    vols = sums.groupBy(*keys).agg(
        F.sum(w * F.least("max_s", "max_r")).alias("_i"), F.sum(w * F.greatest("max_s", "max_r")).alias("_u"),
        F.sum(w * F.col("max_s")).alias("_s"), F.sum(w * F.col("max_r")).alias("_r"),
    )
    p, r = zero_if_null(F.try_divide("_i", "_s")), zero_if_null(F.try_divide("_i", "_r"))
    return vols.select(
        *keys, zero_if_null(F.try_divide("_i", "_u")).alias("soft_jaccard"), p.alias("soft_precision"),
        r.alias("soft_recall"), harmonic(p, r).alias("soft_f1"),
        F.col("_s").alias("soft_source_regions"), F.col("_r").alias("soft_reference_regions"),
    )


def soft_coverage(
    source: DataFrame, reference: DataFrame, keys: Sequence[str], low: float = 0.60, high: float = 0.80,
    pool: DataFrame | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fuzzy overlap of the regions covered by both sets.  Probes are both sets, each weighted by one over the
    soft number of statements covering it; an external ``pool`` of probes is unweighted."""
    keys = list(keys)
    both = source.select(*keys, F.lit("s").alias("side"), "id", "vec").unionByName(
        reference.select(*keys, F.lit("r").alias("side"), "id", "vec"))
    if pool is not None:
        return _coverage_rates(pool_coverage(pool, both, keys, low, high, block_rows=block_rows), keys, F.lit(1.0))
    present = [F.count_if(F.col("side") == side) > 0 for side in ("s", "r")]
    two_sided = both.groupBy(*keys).agg((present[0] & present[1]).alias("_both")).where("_both").select(*keys)
    sums = coverage_sums(both.join(two_sided, keys, "left_semi"), keys, low, high, block_rows=block_rows)
    return _coverage_rates(sums, keys, 1 / F.greatest(F.col("sum_s") + F.col("sum_r"), F.lit(1e-9)))


def compare_sets(
    source: DataFrame, reference: DataFrame, keys: Sequence[str], threshold: float = 0.75, low: float = 0.60,
    high: float = 0.80, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All embedding metrics per key; keys missing on one side get zeros and a status."""
    keys = list(keys)
    counts = (
        source.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidate_count"))
        .join(reference.groupBy(*keys).agg(F.count(F.lit(1)).alias("ideal_count")), keys, "full")
        .na.fill(0, ["candidate_count", "ideal_count"])
    )
    out = counts
    for part in (
        best_match_means(source, reference, keys, block_rows),
        one_to_one_jaccard(source, reference, keys, threshold, block_rows).drop("matched"),
        soft_coverage(source, reference, keys, low, high, block_rows=block_rows),
    ):
        out = join_on(out, part, keys, "left")
    filled = [c for c in out.columns if c not in {*keys, "candidate_count", "ideal_count"}]
    return out.na.fill(0.0, filled).withColumn("status", run_status(F.col("candidate_count"), F.col("ideal_count")))


def with_composite(compared: DataFrame, semantic: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds to ``compare_sets`` the profile score of each key and its label. ``semantic`` holds keys and the ``semantic`` cosine of
    the two whole texts; a key without it has 0."""
    ws, wj, wb = COMPOSITE_SETS
    out = join_on(compared, semantic.select(*keys, zero_if_null(F.col("semantic")).alias("profile_semantic_similarity")), list(keys), "left")
    out = out.na.fill(0.0, ["profile_semantic_similarity"])
    total = ws * F.col("profile_semantic_similarity") + wj * F.col("semantic_jaccard") + wb * F.col("symmetric_best_mean")
    return out.withColumn("profile_composite_score", F.round(total, 4)).withColumn("profile_interpretation", tx.score_label(total))


def run_status(candidates: Column, ideals: Column) -> Column:
    return F.when(ideals == 0, "missing_ideal").when(candidates == 0, "empty_candidate").otherwise("ok")


def baseline_status(rows: Column, baseline_rows: Column) -> Column:
    return F.when(baseline_rows == 0, "missing_qwen_input").when(rows == 0, "missing_input").otherwise("ok")


# Judge ------------------------------------------------------------------------------------------------

def shortlist(reference: DataFrame, prediction: DataFrame, keys: Sequence[str], k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (i in reference, j in prediction) among the top ``k`` of either side."""
    best = top_matches(reference, prediction, keys, k=k, block_rows=block_rows)
    left = F.col("side") == "left"
    return best.select(
        *keys, F.when(left, F.col("id")).otherwise(F.col("other")).alias("i"),
        F.when(left, F.col("other")).otherwise(F.col("id")).alias("j"), "cos",
    ).distinct()


def judge_rows(scored: DataFrame, keys: Sequence[str], own: str, other: str, threshold: float, top_k: int) -> DataFrame:
    """Per ``own`` id with at least one scored pair: best score and the matches among its top ``top_k`` that
    reach ``threshold`` (ties by larger partner)."""
    rank = F.row_number().over(Window.partitionBy(*keys, own).orderBy(F.desc("score"), F.desc(other)))
    return (
        scored.withColumn("_k", rank).where(F.col("_k") <= top_k)
        .groupBy(*keys, own).agg(
            F.max("score").alias("best_score"),
            F.sort_array(F.collect_list(F.when(F.col("score") >= threshold, F.struct("_k", F.col(other).alias("id"), F.round("score", 6).alias("score"))))).alias("_m"),
        )
        .select(
            *keys, own, "best_score", F.transform("_m", lambda m: m["id"]).alias("matched_ids"),
            F.transform("_m", lambda m: m["score"]).alias("matched_scores"),
        )
    )


def judge(
    reference: DataFrame, prediction: DataFrame, keys: Sequence[str], threshold: float = 0.5, top_k: int = 3,
    scored: DataFrame | None = None, shortlist_k: int = 0, scorer: Callable[[Column, Column], Column] | None = None,
    transform: str = "none", block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coverage rows per reference, support rows per prediction, and the summary per key.

    With ``scorer`` the shortlisted pairs (``shortlist_k`` per side) are scored on their texts; pairs off the
    list can never match.  Without one, cosine is the score, and each side's own top ``top_k`` decide, so no
    pair beyond those is formed.  ``scored(i, j, score)`` may be given instead.
    """
    keys = list(keys)
    if scored is not None:
        left = right = scored
    elif scorer is not None:
        if shortlist_k < 1:
            raise ValueError("scoring every pair of texts needs a shortlist")
        pairs = shortlist(reference, prediction, keys, shortlist_k, block_rows)
        texts = pairs.join(reference.select(*keys, F.col("id").alias("i"), F.col("text").alias("_a")), [*keys, "i"]).join(
            prediction.select(*keys, F.col("id").alias("j"), F.col("text").alias("_b")), [*keys, "j"])
        score = vx.score_transform(scorer(F.col("_a"), F.col("_b")), transform)
        left = right = texts.select(*keys, "i", "j", score.alias("score"))
    else:
        best = top_matches(reference, prediction, keys, k=top_k, block_rows=block_rows)
        score = vx.score_transform(F.col("cos"), transform).alias("score")
        left = best.where("side = 'left'").select(*keys, F.col("id").alias("i"), F.col("other").alias("j"), score)
        right = best.where("side = 'right'").select(*keys, F.col("other").alias("i"), F.col("id").alias("j"), score)
    cover = reference.select(*keys, F.col("id").alias("i")).join(judge_rows(left, keys, "i", "j", threshold, top_k), [*keys, "i"], "left")
    support = prediction.select(*keys, F.col("id").alias("j")).join(judge_rows(right, keys, "j", "i", threshold, top_k), [*keys, "j"], "left")
    hit = F.coalesce(F.size("matched_ids"), F.lit(0)) > 0
    coverage = cover.withColumn("coverage", F.when(hit, "COVERED").otherwise("NOT_COVERED"))
    supports = support.withColumn("label", F.when(hit, "SUPPORTED").otherwise("UNSUPPORTED"))
    c = coverage.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reference_count"), F.count_if(F.col("coverage") == "COVERED").alias("covered_count"),
        F.avg("best_score").alias("mean_best_ref_to_pred_score"))
    s = supports.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("prediction_count"), F.count_if(F.col("label") == "SUPPORTED").alias("supported_count"),
        F.avg("best_score").alias("mean_best_pred_to_ref_score"))
    summary = c.join(s, keys, "full").na.fill(0, ["reference_count", "covered_count", "prediction_count", "supported_count"])
    recall = zero_if_null(F.try_divide(F.col("covered_count").cast("double"), F.col("reference_count")))
    precision = zero_if_null(F.try_divide(F.col("supported_count").cast("double"), F.col("prediction_count")))
    summary = summary.withColumn("recall_rate", recall).withColumn("precision_rate", precision).withColumn(
        "f1_score", harmonic(precision, recall))
    return coverage, supports, summary


# Agreement --------------------------------------------------------------------------------------------

def rater_agreement(ratings: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cohen's κ and Gwet's AC1 (pooled categories, half-sum form) of two label columns, per key.  Only the
    contingency table leaves the scan.  Null where expected agreement is 1."""
    keys = list(keys) or ["_all"]
    rows = ratings if "_all" not in keys else ratings.withColumn("_all", F.lit(1))
    cells = rows.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    total = cells.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_c")).otherwise(0)).alias("_same"))
    sides = cells.select(*keys, F.col("_a").alias("_l"), F.col("_c").alias("_ca"), F.lit(0).cast("bigint").alias("_cb")).unionByName(
        cells.select(*keys, F.col("_b").alias("_l"), F.lit(0).cast("bigint").alias("_ca"), F.col("_c").alias("_cb")))
    margins = sides.groupBy(*keys, "_l").agg(F.sum("_ca").alias("_ca"), F.sum("_cb").alias("_cb")).join(total, keys)
    pa, pb = F.col("_ca") / F.col("n"), F.col("_cb") / F.col("n")
    pooled = (F.col("_ca") + F.col("_cb")) / (2 * F.col("n"))
    expected = margins.groupBy(*keys).agg(
        F.sum(pa * pb).alias("_pe"), (F.sum(2 * pooled * (1 - pooled)) / 2).alias("_pg"))
    po = F.col("_same") / F.col("n")
    out = total.join(expected, keys).select(
        *keys, "n", po.alias("observed"),
        F.try_divide(po - F.col("_pe"), 1 - F.col("_pe")).alias("kappa"),
        F.try_divide(po - F.col("_pg"), 1 - F.col("_pg")).alias("ac1"),
    )
    return out.drop("_all")


def rater_pairs(labels: DataFrame, item: str = "item", rater: str = "rater", label: str = "label") -> DataFrame:
    """Agreement of every ordered pair of raters on their common items."""
    other = labels.select(item, F.col(rater).alias("rater_b"), F.col(label).alias("_lb"))
    joined = labels.select(item, F.col(rater).alias("rater_a"), F.col(label).alias("_la")).join(other, item)
    return rater_agreement(joined.where(F.col("rater_a") != F.col("rater_b")), "_la", "_lb", ["rater_a", "rater_b"])


# Profiles ---------------------------------------------------------------------------------------------

def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two string lists ignoring case; 1 when both are empty, 0 when one is."""
    x, y = F.transform(a, F.lower), F.transform(b, F.lower)
    na, nb = F.size(a), F.size(b)
    return (
        F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0)
        .otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    )


def _string_lists(raw: str | None) -> list[dict]:
    """Non-empty lists of strings of a JSON text at any depth, with their dotted path; malformed text has none."""
    try:
        todo = [("", json.loads(raw))] if raw else []
    except (ValueError, RecursionError):
        return []
    found = []
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
        elif isinstance(value, list) and value and path and all(isinstance(v, str) for v in value):
            found.append({"path": path, "items": value})
    return found


def profile_fields(profiles: DataFrame, keys: Sequence[str], doc: str = "profile") -> DataFrame:
    """Open profile JSON → rows (path, items): every non-empty list made of strings only, by dotted path, however deep."""

    @F.arrow_udf("array<struct<path: string, items: array<string>>>")
    def walk(docs: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("path", pa.string()), ("items", pa.list_(pa.string()))]))
        return pa.array([_string_lists(d) for d in docs.to_pylist()], kind)

    return profiles.select(*keys, F.inline(walk(F.col(doc))))


def profile_text(fields: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All items of a profile as one text, in path order."""
    return fields.groupBy(*keys).agg(
        F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("path", "items"))), lambda e: e["items"])), " ").alias("text"))


def field_weight(path: Column) -> Column:
    low = F.lower(path)
    out = F.when(F.contains(low, F.lit(FIELD_WEIGHTS[0][0])), F.lit(FIELD_WEIGHTS[0][1]))
    for name, weight in FIELD_WEIGHTS[1:]:
        out = out.when(F.contains(low, F.lit(name)), F.lit(weight))
    return out.otherwise(F.lit(DEFAULT_WEIGHT))


def field_similarity(fields: DataFrame, pairs: DataFrame, profile: str = "profile_id") -> DataFrame:
    """Per requested pair (a, b) and path on either side: list Jaccard and the path's weight."""
    left = pairs.join(fields.withColumnRenamed(profile, "a"), "a").withColumnRenamed("items", "_x")
    right = pairs.join(fields.withColumnRenamed(profile, "b"), "b").withColumnRenamed("items", "_y")
    empty = F.array().cast("array<string>")
    both = left.join(right, ["a", "b", "path"], "full")
    return both.select(
        "a", "b", "path", set_jaccard(F.coalesce("_x", empty), F.coalesce("_y", empty)).alias("jaccard"),
        field_weight(F.col("path")).alias("weight"),
        F.coalesce("_x", empty).alias("items_a"), F.coalesce("_y", empty).alias("items_b"),
    )


def text_cosine(fields: DataFrame, pairs: DataFrame, profile: str = "profile_id") -> DataFrame:
    """Per requested pair (a, b) the cosine of the profiles' word counts over all items (``semantic``), and its mean over the paths
    of either side (``average_semantic``; a path on one side only counts 0).

    Words stand in an inverted index, so a pair meets only where both sides have a word, and only sums leave the join. A pair without
    a common word, or with an empty side, has 0.
    """
    words = fields.select(profile, "path", F.explode(F.split(F.array_join("items", " "), " ")).alias("word")).where("word != ''")
    by_path = words.groupBy(profile, "path", F.lower("word").alias("word")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    whole = by_path.groupBy(profile, "word").agg(F.sum("c").alias("c"))

    def cosines(counts: DataFrame, on: list[str]) -> DataFrame:
        norms = counts.groupBy(profile, *on).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
        held = counts.join(norms, [profile, *on]).select(profile, *on, "word", (F.col("c") / F.col("n")).alias("c"))
        left = pairs.join(held.withColumnsRenamed({profile: "a", "c": "_x"}), "a")
        right = held.withColumnsRenamed({profile: "b", "c": "_y"})
        return left.join(right, ["b", *on, "word"]).groupBy("a", "b", *on).agg(F.sum(F.col("_x") * F.col("_y")).alias("cos"))

    paths = fields.select(profile, "path").distinct()
    sides = pairs.join(paths.withColumnRenamed(profile, "a"), "a").unionByName(pairs.join(paths.withColumnRenamed(profile, "b"), "b")).distinct()
    mean = sides.join(cosines(by_path, ["path"]), ["a", "b", "path"], "left").groupBy("a", "b").agg(F.avg(zero_if_null(F.col("cos"))).alias("average_semantic"))
    total = cosines(whole, []).withColumnRenamed("cos", "semantic")
    out = pairs.join(total, ["a", "b"], "left").join(mean, ["a", "b"], "left")
    return out.select("a", "b", *[zero_if_null(F.col(c)).alias(c) for c in ("semantic", "average_semantic")])


def profile_scores(field_sims: DataFrame, semantic: DataFrame) -> DataFrame:
    """Composite, weighted and average scores with a label; ``semantic`` holds the text similarity per pair, and may hold the mean of
    the fields' (``average_semantic``)."""
    agg = field_sims.groupBy("a", "b").agg(
        zero_if_null(F.try_divide(F.sum(F.col("jaccard") * F.col("weight")), F.sum("weight"))).alias("_w"),
        F.avg("jaccard").alias("_j"),
    )
    cs, cw, cj = COMPOSITE_PROFILE
    total = cs * zero_if_null(F.col("semantic")) + cw * F.col("_w") + cj * F.col("_j")
    return agg.join(semantic, ["a", "b"], "left").select(
        "a", "b", F.round(total, 4).alias("composite_score"), F.round(zero_if_null(F.col("semantic")), 4).alias("semantic_similarity"),
        F.round("_w", 4).alias("weighted_jaccard"), F.round("_j", 4).alias("average_jaccard"),
        *([F.round("average_semantic", 4).alias("average_semantic")] if "average_semantic" in semantic.columns else []),
        tx.score_label(total).alias("interpretation"),
    )


def mirrored(scores: DataFrame, value: str) -> DataFrame:
    """Symmetric matrix rows (a, b, value) from the upper triangle, with 1 on the diagonal."""
    up = scores.select("a", "b", value)
    names = up.select("a").unionByName(up.select(F.col("b").alias("a"))).distinct()
    return up.unionByName(up.select(F.col("b").alias("a"), F.col("a").alias("b"), value)).unionByName(
        names.select("a", F.col("a").alias("b"), F.lit(1.0).alias(value)))


def centroid_distances(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Cosine distance of every ordered pair of key centroids (0 on the diagonal).

    The matrix is the result, one row per pair of keys, so its size is the square of the number of keys;
    the pairs come from an equi-join on hashed centroid buckets, never from the rows themselves.
    """
    mids = centroids(rows, [key], vec)
    n = 8
    left = mids.withColumn("_l", F.pmod(F.xxhash64(key), F.lit(n))).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = mids.withColumn("_r", F.pmod(F.xxhash64(key), F.lit(n))).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = right.select("_l", "_r", F.col(key).alias("b"), F.col("centroid").alias("_c"))
    return left.withColumn("_l", F.col("_l").cast("int")).withColumn("_r", F.col("_r").cast("int")).join(
        right.withColumn("_l", F.col("_l").cast("int")).withColumn("_r", F.col("_r").cast("int")), ["_l", "_r"]
    ).select(
        F.col(key).alias("a"), "b",
        F.when(F.col(key) == F.col("b"), 0.0).otherwise(vx.cosine_distance(F.col("centroid"), F.col("_c"))).alias("distance"),
    )


# Calibration ------------------------------------------------------------------------------------------

def match_curve(sample: DataFrame, user: str, bins: int) -> DataFrame:
    """Mean 0/1 match per cosine bin, per user and pooled (``user`` null); empty bins stay null.  The sample, which stands for a
    product of all pairs, is formed once."""
    sample = cut(sample)
    rates = sample.groupingSets([[F.col(user), F.col("bin")], [F.col("bin")]], user, "bin").agg(
        F.avg(F.col("match").cast("double")).alias("p_match"), F.count(F.lit(1)).alias("n_pairs"))
    users = sample.select(user).distinct().unionByName(sample.select(F.lit(None).cast(sample.schema[user].dataType).alias(user)).distinct())
    grid = users.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    same = F.col("g._u").eqNullSafe(F.col("r._u")) & (F.col("g.bin") == F.col("r.bin"))
    g = grid.withColumnRenamed(user, "_u").alias("g")
    r = rates.withColumnRenamed(user, "_u").alias("r")
    return g.join(r, same, "left").select(
        F.col("g._u").alias(user), F.col("g.bin"), F.col("r.p_match"), F.coalesce(F.col("r.n_pairs"), F.lit(0)).alias("n_pairs"))


def crossing(curve: DataFrame, keys: Sequence[str], level: float, x: str = "centre", p: str = "p_match") -> DataFrame:
    """Where the running maximum of ``p`` over ``x`` first reaches ``level``, by linear interpolation; the end
    points bound it.  A curve has one row per bin, so its window is as small as the number of bins."""
    keys = list(keys)
    row = Window.partitionBy(*keys).orderBy(x)
    env = (
        curve.where(F.col(p).isNotNull())
        .withColumn("_e", F.max(p).over(row.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_e0", F.lag("_e").over(row)).withColumn("_x0", F.lag(x).over(row))
    )
    at = F.when(
        F.col("_e0").isNull() | (F.col("_e") == F.col("_e0")), F.col(x)
    ).otherwise(F.col("_x0") + (F.lit(level) - F.col("_e0")) / (F.col("_e") - F.col("_e0")) * (F.col(x) - F.col("_x0")))
    # np.interp on a plateau that starts exactly at the level answers its last point
    return env.groupBy(*keys).agg(
        F.coalesce(
            F.max(F.when(F.col("_e") == level, F.col(x))),
            F.min_by(at, F.when(F.col("_e") > level, F.col(x))),
            F.max(x),
        ).alias("crossing"))


def background(sample: DataFrame, user: str, quantiles: Sequence[float] = (0.5, 0.9, 0.95, 0.99), value: str = "cos") -> DataFrame:
    """Mean and exact quantiles (linear interpolation) of sampled cosines, per user and pooled."""
    marks = F.array(*[F.lit(float(q)) for q in quantiles])
    return sample.groupingSets([[F.col(user)], []], user).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile(value, marks).alias("q"))


def random_pairs(rows: DataFrame, user: str, draws: int, seed: int = 0, vec: str = "vec", ordinal: str = "ord") -> DataFrame:
    """``draws`` pairs per user with replacement; ``ordinal`` is dense from 0 per user.  Both ends are draws by an MD5 of user,
    draw, seed and side, which any engine repeats, joined on the ordinal, so only the drawn rows move.  A row may meet itself."""
    counts = rows.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    drawn = counts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    for side in ("i", "j"):
        digest = F.md5(F.concat_ws(":", F.col(user).cast("string"), F.col("draw").cast("string"), F.lit(str(seed)), F.lit(side)))
        drawn = drawn.withColumn(side, F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint"), F.col("_n")))
    left = rows.select(user, F.col(ordinal).alias("i"), F.col(vec).alias("_a"))
    right = rows.select(user, F.col(ordinal).alias("j"), F.col(vec).alias("_b"))
    return drawn.join(left, [user, "i"]).join(right, [user, "j"]).select(
        user, "draw", "i", "j", vx.dot(F.col("_a"), F.col("_b")).alias("cos"))


def calibrate_bounds(
    rows: DataFrame, user: str, match: Callable[[DataFrame], DataFrame], background_sample: DataFrame,
    low: float = 0.30, width: float = 0.05, bins: int = 14, per_bin: int = 120, low_level: float = 0.5,
    high_level: float = 0.99, quantile: float = 0.90, min_items: int = 50, seed: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Soft-metric bounds from judged pairs → (one-row bounds, match curve).

    ``match`` adds a 0/1 ``match`` column to the stratified pairs (user, bin, i, j, cos), which are formed and judged once.
    ``background_sample`` holds cosines of pairs drawn at random (``random_pairs``); the guard is their quantile.
    """
    enough = rows.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_items)
    used = rows.join(enough.select(user), user, "left_semi")
    judged = match(binned_pairs(used, [user], low, width, bins, per_bin, block_rows=block_rows, seed=seed))
    curve = match_curve(judged, user, bins).withColumn("centre", F.lit(low) + (F.col("bin") + 0.5) * width)
    pooled = curve.where(F.col(user).isNull()).withColumn("_one", F.lit(1))
    lo = crossing(pooled, ["_one"], low_level).withColumnRenamed("crossing", "low_crossing")
    hi = crossing(pooled, ["_one"], high_level).withColumnRenamed("crossing", "high_crossing")
    kept = background_sample.join(enough.select(user), user, "left_semi")
    guard = kept.agg(F.percentile("cos", F.lit(float(quantile))).alias("background")).withColumn("_one", F.lit(1))
    bounds = lo.join(hi, "_one").join(guard, "_one").select(
        vx.round_to_step(F.greatest("low_crossing", "background")).alias("low"),
        vx.round_to_step(F.col("high_crossing")).alias("high"),
        "low_crossing", "high_crossing", "background",
    )
    return bounds, curve


# Tree preservation ------------------------------------------------------------------------------------

def preservation(rows: DataFrame, raw: Column, kept: Column, sample: int | None = None) -> DataFrame:
    """Share of raw tokens that survive cleaning, in percent, with the ``missing`` ones, and the first ``sample`` of them where
    that is asked for.  A record whose tree has no tokens that count has lost none: it scores 100.  Records without a tree are
    not scored at all: leave them out first (``trees.has_root``)."""
    missing = F.array_except(raw, kept)
    score = F.when(F.size(raw) == 0, 100.0).otherwise(100.0 * (1 - F.size(missing) / F.size(raw)))
    out = (
        rows.withColumn("score", F.round(score, 2)).withColumn("raw_count", F.size(raw))
        .withColumn("kept_count", F.size(kept)).withColumn("missing", missing)
        .withColumn("status", F.when(F.col("score") < 50, "BAD").when(F.col("score") > 85, "OK").otherwise("LOW"))
    )
    return out if sample is None else out.withColumn("missing_sample", F.slice("missing", 1, sample))


def preservation_mean(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of scored records, their mean score (0 where there are none) and how many have each status, per key."""
    states = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "LOW", "BAD")]
    mean = F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score")
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"), mean, *states)
