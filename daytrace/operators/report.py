"""Result tables: two-level means, confidence intervals, pivots, marks, frontiers and fits.

Run rows carry user, model, method, modalities, status and metric columns.  Reports aggregate runs first;
windows here order aggregated cells or points, never raw runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from daytrace.session import cut

# Fixed values -----------------------------------------------------------------------------------------
# two-sided 95 % Student-t values for 1 to 30 degrees of freedom, then the normal value
T95 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
]
Z95 = 1.960
MODALITIES = ["ax", "metadata", "ocr", "screen"]
# ------------------------------------------------------------------------------------------------------


def subset_size(mods: Column) -> Column:
    return F.size(F.split(mods, r"\+"))


def subset_order(mods: Column, order: Sequence[str] = MODALITIES) -> list[Column]:
    """Sort keys of a modality subset: its size, then the members' positions in the given order."""
    names = F.array(*[F.lit(m) for m in order])
    return [subset_size(mods), F.transform(F.split(mods, r"\+"), lambda m: F.array_position(names, m))]


def method_order(method: Column, order: Sequence[str]) -> Column:
    """Position in ``order``; unknown methods come last."""
    at = F.array_position(F.array(*[F.lit(m) for m in order]), method)
    return F.when(at == 0, len(order) + 1).otherwise(at)


def expand_subsets(items: DataFrame, subsets: Sequence[str], keys: Sequence[str], modality: str = "modality", only_complete: bool = True) -> DataFrame:
    """Copy every item into each modality subset that holds its modality, so a sweep over subsets is one job.
    With ``only_complete`` a (key, subset) needs all members of the subset to be present."""
    keys = list(keys)
    listed = F.array(*[F.lit(s) for s in subsets])
    # membership by splitting; the subset list is a literal, so this is a projection and not a join
    fits = F.filter(listed, lambda s: F.array_contains(F.split(s, r"\+"), F.col(modality)))
    out = items.withColumn("mods", F.explode(fits))
    if not only_complete:
        return out
    present = items.select(*keys, modality).distinct().groupBy(*keys).agg(F.collect_set(modality).alias("_have"))
    whole = F.size(F.array_except(F.split("mods", r"\+"), F.col("_have"))) == 0
    return out.join(present, keys).where(whole).drop("_have")


def resolve_runs(runs: DataFrame, keys: Sequence[str] = ("user", "model", "method", "modalities"), modalities: Sequence[str] = MODALITIES) -> DataFrame:
    """Ok runs with ``modalities`` reduced to those that held data (``count_<m>`` of 0 marks absence, null
    does not); a reduced run stays only where no native run has the same key."""
    keys = list(keys)
    asked = F.split("modalities", r"\+")
    counts = F.map_from_arrays(
        F.array(*[F.lit(m) for m in modalities]),
        F.array(*[F.col(f"count_{m}").cast("double") if f"count_{m}" in runs.columns else F.lit(None).cast("double") for m in modalities]))
    present = F.filter(asked, lambda m: F.coalesce(F.try_element_at(counts, m), F.lit(-1.0)) != 0)
    rows = (
        runs.where("status = 'ok'").withColumn("_p", present).where(F.size("_p") > 0)
        .withColumn("native", F.size("_p") == F.size(asked)).withColumn("modalities", F.array_join("_p", "+")).drop("_p")
    )
    natives = rows.where("native").select(*keys).distinct()
    return rows.where("native").unionByName(rows.where("not native").join(natives, keys, "left_anti"))


def paired_runs(runs: DataFrame, keys: Sequence[str] = ("user", "model", "modalities"), method: str = "method") -> DataFrame:
    """Runs whose key exists under every method of the table."""
    keys = list(keys)
    methods = runs.select(method).distinct().agg(F.count(F.lit(1)).alias("_all")).withColumn("_one", F.lit(1))
    common = (
        runs.select(*keys, method).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).withColumn("_one", F.lit(1))
        .join(F.broadcast(methods), "_one")  # one row
        .where("_m = _all").select(*keys)
    )
    return runs.join(common, keys, "left_semi")


def two_level_mean(runs: DataFrame, by: Sequence[str], inner: str, values: Sequence[str]) -> DataFrame:
    """Mean within ``inner`` first, then over it; ``runs`` counts the rows that had every value."""
    whole = runs.dropna(subset=list(values))
    first = whole.groupBy(*by, inner).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(v).alias(v) for v in values])
    return first.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values], F.sum("_n").alias("runs"))


def mean_ci(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and 95 % half-width (null below two values) of ``value`` per group."""
    table = F.array(*[F.lit(t) for t in T95])
    stats = values.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    t = F.when(F.col("n") - 1 <= len(T95), F.try_element_at(table, (F.col("n") - 1).cast("int"))).otherwise(F.lit(Z95))
    half = F.when(F.col("n") >= 2, t * F.col("_sd") / F.sqrt(F.col("n")))
    return stats.withColumn("ci", half).drop("_sd")


def cells(runs: DataFrame, metric: str, size: str = "eval_count") -> DataFrame:
    """Table cells (modalities, method): mean ± CI over models (sessions averaged first), size, model count."""
    on = ["modalities", "method"]
    per_model = runs.groupBy(*on, "model").agg(F.avg(metric).alias("_v"), F.avg(size).alias("_s"))
    ci = mean_ci(per_model, on, "_v").withColumnRenamed("n", "n_values")
    sizes = per_model.groupBy(*on).agg(F.avg("_s").alias("size"), F.count(F.lit(1)).alias("n_models"))
    return sizes.join(ci, on, "left")


def mark_cells(table: DataFrame, line: str, value: str = "mean", decimals: int = 3) -> DataFrame:
    """Best and second-best per ``line`` on rounded values, ties sharing; none with a single level, no second
    with two.  One row per table cell."""
    shown = F.round(value, decimals)
    levels = Window.partitionBy(line)
    ranked = table.withColumn("_r", F.when(F.col(value).isNotNull(), F.dense_rank().over(levels.orderBy(shown.desc_nulls_last()))))
    ranked = ranked.withColumn("_l", F.max("_r").over(levels))
    mark = F.when((F.col("_r") == 1) & (F.col("_l") > 1), "best").when((F.col("_r") == 2) & (F.col("_l") > 2), "second")
    return ranked.withColumn("mark", mark).drop("_r", "_l")


def pivot_table(table: DataFrame, methods: Sequence[str], value: str = "mean") -> DataFrame:
    """Rows = modality subsets in report order, one column per method."""
    wide = table.groupBy("modalities").pivot("method", list(methods)).agg(F.first(value))
    return wide.orderBy(*subset_order(F.col("modalities")), "modalities")


def table_footer(table: DataFrame, base: str = "none") -> DataFrame:
    """Per method: mean over subsets, mean size, and the change against the ``base`` method in percent."""
    means = table.groupBy("method").agg(F.avg("mean").alias("mean"), F.avg("size").alias("size"))
    ref = means.where(F.col("method") == base).select(F.col("mean").alias("_base"), F.lit(1).alias("_one"))
    return means.withColumn("_one", F.lit(1)).join(ref, "_one", "left").select(
        "method", "mean", "size", (F.try_divide(F.col("mean") - F.col("_base"), F.col("_base")) * 100).alias("vs_base_percent"))


def slices(runs: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """Mean of ``value`` for every combination of dimension values including 'all'."""
    rolled = [F.grouping(d).alias(f"_g_{d}") for d in dims]
    out = runs.cube(*dims).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("runs"), *rolled)
    shown = [F.when(F.col(f"_g_{d}") == 1, "all").otherwise(F.col(d).cast("string")).alias(d) for d in dims]
    return out.select(*shown, value, "runs")


def frontier(points: DataFrame, x: str = "x", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Points no other point beats (x lower or equal, y higher or equal, one of them strictly).

    Window form of the dominance anti-join: a point stays when its y is the best at its x and above every y at
    smaller x.  Points are first thinned to the frontier of each hashed slice, so what meets in the last
    window is a union of frontiers and not all points.  The points are written once, as they meet their own maxima again
    by equality and a mean evaluated twice may differ in its last bit.
    """
    keys, points = list(keys), cut(points)

    def steps(rows: DataFrame, by: list[str]) -> DataFrame:
        before = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
        seen = rows.withColumn("_prev", F.max("_top").over(before))
        return seen.where(F.col("_prev").isNull() | (F.col("_top") > F.col("_prev"))).drop("_prev")

    keyed = keys or ["_one"]
    source = points if keys else points.withColumn("_one", F.lit(1))
    tops = source.groupBy(*keyed, x).agg(F.max(y).alias("_top")).withColumn("_slice", F.pmod(F.xxhash64(x), F.lit(64)))
    good = steps(steps(tops, [*keyed, "_slice"]), keyed).select(*keys, x, F.col("_top").alias(y))
    return points.join(good, [*keys, x, y], "left_semi")


def knee(front: DataFrame, x: str = "x", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Frontier point with the largest gap between its scaled y and its scaled log10 x, ends included; the
    smallest x on ties."""
    keys = list(keys) or ["_one"]
    pts = front if "_one" not in keys else front.withColumn("_one", F.lit(1))
    lx = F.when(F.col(x) > 0, F.log10(F.when(F.col(x) > 0, F.col(x)))).otherwise(0.0)
    pts = pts.withColumn("_lx", lx)
    ends = pts.groupBy(*keys).agg(
        F.min_by("_lx", x).alias("_x0"), F.max_by("_lx", x).alias("_x1"), F.min_by(y, x).alias("_y0"), F.max_by(y, x).alias("_y1"))
    share = lambda v, lo, hi: F.coalesce(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)), F.lit(0.0))
    gap = share(y, "_y0", "_y1") - share("_lx", "_x0", "_x1")
    best = pts.join(ends, keys).groupBy(*keys).agg(F.max_by(F.struct(*front.columns), F.struct(gap, -F.col(x))).alias("_k"))
    return best.select(*[f"_k.{c}" for c in front.columns])


def fit_line(points: DataFrame, x: str = "x", y: str = "y", log_x: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares y = a + b·x (or log10 x) with R²; slope 0 when x does not vary, R² null when y does not."""
    v = F.log10(x) if log_x else F.col(x)
    out = points.withColumn("_v", v).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("_my"), F.avg("_v").alias("_mv"),
        F.covar_pop("_v", y).alias("_c"), F.var_pop("_v").alias("_vv"), F.var_pop(y).alias("_vy"))
    slope = F.coalesce(F.try_divide("_c", "_vv"), F.lit(0.0))
    r2 = F.when(F.col("_vv") == 0, F.when(F.col("_vy") != 0, 0.0)).otherwise(F.try_divide(F.col("_c") * F.col("_c"), F.col("_vv") * F.col("_vy")))
    return out.select(*keys, slope.alias("slope"), (F.col("_my") - slope * F.col("_mv")).alias("intercept"), r2.alias("r2"), "n")


def quality_points(runs: DataFrame, x: str, y: str) -> DataFrame:
    """Report points (modalities, method): x and y averaged over models within a session, then sessions."""
    ok = runs.where("status = 'ok'")
    return two_level_mean(ok, ["modalities", "method"], "user", [x, y]).select(
        "modalities", "method", F.col(x).alias("x"), F.col(y).alias("y"), "runs")


def modality_summary(runs: DataFrame, metric: str) -> DataFrame:
    """Per modality subset: macro mean over sessions, spread (max − min), and flags for best, weakest and
    least stable subset."""
    ok = runs.where("status = 'ok'").dropna(subset=[metric])
    per = ok.groupBy("modalities", "user").agg(F.avg(metric).alias("_v"))
    out = per.groupBy("modalities").agg(
        F.avg("_v").alias("mean"), (F.max("_v") - F.min("_v")).alias("spread"), F.count(F.lit(1)).alias("sessions"))
    out = cut(out)  # evaluated once: its values are compared with their own extremes
    tops = out.agg(F.max("mean").alias("_b"), F.min("mean").alias("_w"), F.max("spread").alias("_s")).withColumn("_one", F.lit(1))
    return out.withColumn("_one", F.lit(1)).join(F.broadcast(tops), "_one").select(  # one row
        "modalities", "mean", "spread", "sessions", (F.col("mean") == F.col("_b")).alias("is_best"),
        (F.col("mean") == F.col("_w")).alias("is_weakest"), (F.col("spread") == F.col("_s")).alias("is_least_stable"))


def best_run_flag(runs: DataFrame, metric: str = "f1_score", keys: Sequence[str] = ("user", "model")) -> DataFrame:
    """Flags the runs with the best metric of their (user, model); the maxima aggregate map-side.  The runs are written once, so
    that a metric is compared with itself and not with a second evaluation, whose sums may add up in another order."""
    runs = cut(runs)
    best = runs.groupBy(*keys).agg(F.max(metric).alias("_best"))
    return runs.join(best, list(keys)).withColumn("is_best", F.coalesce(F.col(metric) == F.col("_best"), F.lit(False))).drop("_best")


def kept_fraction(evaluated: Column, candidates: Column) -> Column:
    return F.try_divide(evaluated.cast("double"), candidates)


def comparison_table(runs: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Tidy run table: ``eval_count`` falls back to ``candidate_count`` when missing or 0; report order."""
    out = runs.withColumn("eval_count", F.coalesce(F.nullif(F.col("eval_count"), F.lit(0)), F.col("candidate_count")))
    return out.orderBy("user", "modalities", "model", method_order(F.col("method"), methods))


def rotate_3d(points: DataFrame, about_x: float = 25.0, about_y: float = 35.0) -> DataFrame:
    """Fixed rotation of (x, y, z), first about the x axis and then about the y axis (degrees): the plane
    coordinates u, v and the depth."""
    a, b = F.radians(F.lit(about_x)), F.radians(F.lit(about_y))
    v = F.col("y") * F.cos(a) - F.col("z") * F.sin(a)
    w = F.col("y") * F.sin(a) + F.col("z") * F.cos(a)
    return (
        points.withColumn("u", F.col("x") * F.cos(b) + w * F.sin(b)).withColumn("v", v)
        .withColumn("depth", w * F.cos(b) - F.col("x") * F.sin(b))
    )


def project_vectors(rows: DataFrame, k: int = 2, vec: str = "vec") -> DataFrame:
    """Principal components of the vectors as column ``xy`` (deterministic up to sign); the fit is a
    distributed d × d covariance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    boxed = rows.withColumn("_f", array_to_vector(F.col(vec)))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(boxed)
    return model.transform(boxed).withColumn("xy", vector_to_array("_p")).drop("_f", "_p")
