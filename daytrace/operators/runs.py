"""Evaluation of many runs in one job: every user, modality subset and merge arm against the user's reference set.

A run is a set of parts: an unmerged run has its modalities for parts, so fifteen subsets of four modalities share four parts;
a merged run is a part of its own. All pairs of parts that meet in some run, the reference set among them, are multiplied block
by block exactly once. A block pair leaves partial states only: for every probe and every part it was held against the summed
membership and its best partners. The written states are rolled up to runs by a join with the table of runs, so best match,
coverage and the judge's shortlist all come from one product; one-to-one matches are settled run by run in bands (``matching``).

Copies inside a part enter once with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from daytrace.functions import text as tx
from daytrace.functions import vectors as vx
from daytrace.functions.common import join_on
from daytrace.operators import merge as mg
from daytrace.operators.evaluate import COMPOSITE_SETS, baseline_status, harmonic, run_status, zero_if_null
from daytrace.operators.matching import match_sets
from daytrace.operators.report import MODALITIES
from daytrace.operators.similarity import BLOCK_ROWS, STRIP, _sizes, collapse_copies, vector_sums
from daytrace.session import cut

REFERENCE = ""  # the part that the reference set is
METRICS = [
    "source_to_reference_best_mean", "reference_to_source_best_mean", "symmetric_best_mean", "semantic_jaccard", "soft_jaccard",
    "soft_precision", "soft_recall", "soft_f1", "soft_source_regions", "soft_reference_regions",
]
PROFILE = ["profile_semantic_similarity", "profile_jaccard", "profile_average_semantic", "profile_composite_score", "profile_interpretation"]
JUDGED = ["recall_rate", "precision_rate", "f1_score", "covered_count", "supported_count", "mean_best_ref_to_pred_score", "mean_best_pred_to_ref_score",
          "judge_shortlist_k", "judge_pairs_total", "judge_pairs_scored"]
_PARTNER = "struct<cos: double, other: bigint, n: bigint>"


def _matrix(table: pa.Table) -> np.ndarray:
    chunk = table.column("vec").combine_chunks()
    return chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(chunk), -1)


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """For each row the columns of its best ``k``, nearest first, ties to the later column."""
    if k == 1:
        return sims.shape[1] - 1 - sims[:, ::-1].argmax(1)[:, None]
    return np.argsort(sims, axis=1, kind="stable")[:, ::-1][:, :k]


def _lists(cos: np.ndarray, at: np.ndarray, partners: dict) -> pa.Array:
    """Partners by row, from matrices of cosines and places."""
    flat = at.ravel()
    entries = pa.StructArray.from_arrays([pa.array(cos.ravel()), pa.array(partners["id"][flat]), pa.array(partners["n"][flat])], ["cos", "other", "n"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32()), entries)


def meet_once(
    candidates: DataFrame, references: DataFrame, meetings: DataFrame, keys: Sequence[str], low: float, high: float, partners: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(distinct rows, states) of all meetings, from one product a block pair, strip by strip.

    ``candidates`` hold keys, part, id (unique inside a part) and unit vec, ``references`` the same without part; ``meetings`` hold
    keys and the parts ``lp <= rp`` to be multiplied. States: keys, part and id of the probe, its copies ``n``, the ``centre`` part,
    ``mass`` (ramp memberships in the centre's regions) and ``best`` (its nearest ``partners`` there).
    """
    keys = list(keys)
    rows = candidates.select(*keys, "part", "id", "vec").unionByName(references.select(*keys, F.lit(REFERENCE).alias("part"), "id", "vec"))
    reps, _ = collapse_copies(rows, [*keys, "part"], ["vec"], F.lit(True))
    reps = cut(reps.select(*keys, "part", F.col("id").cast("bigint").alias("id"), F.col("last_id").cast("bigint").alias("last_id"), F.col("n").cast("bigint").alias("n"), "vec"))
    sizes = _sizes(reps, [*keys, "part"], block_rows, "_n", few=True)
    met = join_on(meetings, sizes.withColumnsRenamed({"part": "lp", "_n": "_nl"}), [*keys, "lp"])
    met = join_on(met, sizes.withColumnsRenamed({"part": "rp", "_n": "_nr"}), [*keys, "rp"])
    home = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    one = F.col("lp") == F.col("rp")  # a part with itself: only blocks in order
    row = ["id", "last_id", "n", "vec"]
    lefts = join_on(reps.withColumnRenamed("part", "lp"), met, [*keys, "lp"]).withColumn("_lb", home("_nl"))
    lefts = lefts.select(*keys, "lp", "rp", *row, "_lb", F.explode(F.sequence(F.when(one, F.col("_lb")).otherwise(0), F.col("_nr") - 1)).alias("_rb"))
    rights = join_on(reps.withColumnRenamed("part", "rp"), met, [*keys, "rp"]).withColumn("_rb", home("_nr"))
    rights = rights.select(*keys, "lp", "rp", *row, "_rb", F.explode(F.sequence(F.lit(0), F.when(one, F.col("_rb")).otherwise(F.col("_nl") - 1))).alias("_lb"))
    head = ", ".join(f"`{k}` {reps.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{head}, part string, id bigint, n bigint, centre string, mass double, best array<{_PARTNER}>"
    fields = pa.schema([("part", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("centre", pa.string()), ("mass", pa.float64()),
                        ("best", pa.list_(pa.struct([("cos", pa.float64()), ("other", pa.int64()), ("n", pa.int64())])))])

    def multiply(l: pa.Table, r: pa.Table) -> pa.Table:
        if not (l.num_rows and r.num_rows):
            return pa.table({**{k: (l if l.num_rows else r).column(k).slice(0, 0) for k in keys}, **{f.name: pa.array([], f.type) for f in fields}})
        l, r = l.sort_by("last_id"), r.sort_by("last_id")  # ties go to the larger last id
        lp, rp = l.column("lp")[0].as_py(), l.column("rp")[0].as_py()
        mine, theirs = ({c: t.column(c).to_numpy() for c in ("id", "n")} for t in (l, r))
        a, b = _matrix(l), _matrix(r).T
        k = partners if (lp == REFERENCE) != (rp == REFERENCE) else 1
        both = lp != rp or l.column("_lb")[0].as_py() != l.column("_rb")[0].as_py()
        out, mass = [], np.zeros(b.shape[1])
        top, place = np.zeros((b.shape[1], 0)), np.zeros((b.shape[1], 0), np.int64)

        def told(part: str, probes: dict, rows: slice, centre: str, mass: np.ndarray, best: pa.Array) -> None:
            n = len(mass)
            columns = (pa.repeat(part, n), pa.array(probes["id"][rows]), pa.array(probes["n"][rows]), pa.repeat(centre, n), pa.array(mass), best)
            out.append(pa.table(dict(zip(fields.names, columns))))

        for at in range(0, len(a), STRIP):
            sims = a[at:at + STRIP] @ b
            member = np.clip((sims - low) / (high - low), 0.0, 1.0)
            near = _top(sims, k)
            told(lp, mine, slice(at, at + STRIP), rp, member @ theirs["n"].astype(float), _lists(np.take_along_axis(sims, near, 1), near, theirs))
            if both:
                mass += mine["n"][at:at + STRIP].astype(float) @ member
                near = _top(sims.T, k)
                top, place = np.hstack([top, np.take_along_axis(sims.T, near, 1)]), np.hstack([place, near + at])
                order = np.lexsort((place, top), axis=1)[:, ::-1][:, :k]
                top, place = np.take_along_axis(top, order, 1), np.take_along_axis(place, order, 1)
        if both:
            told(rp, theirs, slice(None), lp, mass, _lists(top, place, mine))
        body = pa.concat_tables(out)
        return pa.table({**{k: pa.repeat(l.column(k)[0], body.num_rows) for k in keys}, **{c: body.column(c) for c in body.column_names}})

    groups = [*keys, "lp", "rp", "_lb", "_rb"]
    rights = rights.select(*[F.col(c).alias(c) for c in rights.columns])
    found = cut(lefts.groupBy(*groups).cogroup(rights.groupBy(*groups)).applyInArrow(multiply, schema))
    nearest = F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, partners)
    on = [*keys, "part", "id", "centre"]
    return reps, found.groupBy(*on).agg(F.max("n").alias("n"), F.sum("mass").alias("mass"), nearest.alias("best"))


def _meetings(runs: DataFrame, keys: list[str], run: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parts of each run, the reference among them, against each other: by run, and the distinct ones in order."""
    with_reference = runs.unionByName(runs.select(*keys, *run, F.lit(REFERENCE).alias("part")).distinct())
    by_run = join_on(with_reference, with_reference.withColumnRenamed("part", "centre"), [*keys, *run])
    low, high = F.least("part", "centre").alias("lp"), F.greatest("part", "centre").alias("rp")
    return by_run, by_run.select(*keys, low, high).distinct()


def compare_runs(
    candidates: DataFrame, references: DataFrame, runs: DataFrame, keys: Sequence[str], run: Sequence[str], threshold: float = 0.75,
    low: float = 0.60, high: float = 0.80, judge_threshold: float = 0.5, transform: str = "none", shortlist_k: int = 0,
    scorer: Callable[[Column, Column], Column] | None = None, references_first: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row for each run that has rows on both sides: counts, ``METRICS``, ``PROFILE`` and ``JUDGED`` columns.

    ``candidates``: keys, part, id, text, vec; ``references``: keys, id, text, vec; ``runs``: keys, run columns, part. The judge
    takes cosines for scores, or with ``scorer`` scores the texts of the ``shortlist_k`` nearest rows of either side (each pair of
    distinct rows once for all runs); pairs off the list never match. ``references_first`` breaks ties of the one-to-one matching
    by the reference before the candidate. The whole-set similarity is the cosine of both sides' summed vectors.
    """
    if scorer is not None and shortlist_k < 1:
        raise ValueError("scoring every pair of texts needs a shortlist")
    keys, run = list(keys), list(run)
    on = [*keys, *run]
    runs = cut(runs.select(*on, "part").distinct())
    by_run, meetings = _meetings(runs, keys, run)
    reps, states = meet_once(candidates, references, meetings, keys, low, high, max(shortlist_k, 1), block_rows)
    rolled = join_on(states, by_run, [*keys, "part", "centre"])
    is_ref = F.col("centre") == REFERENCE
    top = F.col("best")[0]["cos"]
    probes = rolled.groupBy(*on, "part", "id").agg(
        F.max("n").alias("n"), F.sum("mass").alias("density"), F.max(F.when(is_ref, top)).alias("to_ref"), F.max(F.when(~is_ref, top)).alias("to_cand"),
        F.flatten(F.collect_list(F.when(is_ref != (F.col("part") == REFERENCE), F.col("best")))).alias("near"),
    )
    probes = cut(probes.where("to_ref is not null and to_cand is not null"))  # runs with rows on both sides
    cand, ref = F.col("part") != REFERENCE, F.col("part") == REFERENCE
    mu_c, mu_r = vx.ramp(F.col("to_cand"), low, high), vx.ramp(F.col("to_ref"), low, high)
    w = F.col("n") / F.greatest("density", F.lit(1e-9))
    weighted = lambda side, value: F.sum(F.when(side, F.col("n") * value)) / F.sum(F.when(side, F.col("n")))
    score_c, score_r = (vx.score_transform(F.col(c), transform) for c in ("to_ref", "to_cand"))
    sums = probes.groupBy(*on).agg(
        F.sum(F.when(cand, F.col("n")).otherwise(0)).alias("source_count"), F.sum(F.when(ref, F.col("n")).otherwise(0)).alias("reference_count"),
        weighted(cand, F.col("to_ref")).alias("source_to_reference_best_mean"), weighted(ref, F.col("to_cand")).alias("reference_to_source_best_mean"),
        F.sum(w * F.least(mu_c, mu_r)).alias("_i"), F.sum(w * F.greatest(mu_c, mu_r)).alias("_u"), F.sum(w * mu_c).alias("_s"), F.sum(w * mu_r).alias("_r"),
        F.sum(F.when(ref & (score_r >= judge_threshold), F.col("n")).otherwise(0)).alias("covered_count"),
        F.sum(F.when(cand & (score_c >= judge_threshold), F.col("n")).otherwise(0)).alias("supported_count"),
        weighted(ref, score_r).alias("mean_best_ref_to_pred_score"), weighted(cand, score_c).alias("mean_best_pred_to_ref_score"),
    )
    p, r = zero_if_null(F.try_divide("_i", "_s")), zero_if_null(F.try_divide("_i", "_r"))
    sums = sums.withColumns({
        "symmetric_best_mean": (F.col("source_to_reference_best_mean") + F.col("reference_to_source_best_mean")) / 2,
        "soft_jaccard": zero_if_null(F.try_divide("_i", "_u")), "soft_precision": p, "soft_recall": r, "soft_f1": harmonic(p, r),
        "soft_source_regions": F.col("_s"), "soft_reference_regions": F.col("_r"),
        "judge_shortlist_k": F.lit(shortlist_k), "judge_pairs_total": F.col("source_count") * F.col("reference_count"),
        "judge_pairs_scored": F.col("source_count") * F.col("reference_count"),
    }).drop("_i", "_u", "_s", "_r")

    # one-to-one matches, run by run
    left = join_on(reps, runs, [*keys, "part"]).select(*on, "id", "n", "vec")
    right = join_on(reps.where(ref).drop("part"), runs.select(*on).distinct(), keys).select(*on, "id", "n", "vec")
    if references_first:
        left, right = right, left
    matched = match_sets(left, right, on, threshold, block_rows=block_rows).groupBy(*on).agg(F.sum("m").alias("_m"))
    out = join_on(sums, matched, on, "left").na.fill(0, ["_m"])
    out = out.withColumn("semantic_jaccard", zero_if_null(F.try_divide(F.col("_m").cast("double"), F.col("source_count") + F.col("reference_count") - F.col("_m")))).drop("_m")
    out = join_on(out, _whole_sets(candidates, references, runs, keys, on), on)
    total = COMPOSITE_SETS[0] * F.col("profile_semantic_similarity") + COMPOSITE_SETS[1] * F.col("semantic_jaccard") + COMPOSITE_SETS[2] * F.col("symmetric_best_mean")
    out = out.withColumns({"profile_composite_score": F.round(total, 4), "profile_interpretation": tx.score_label(total)})
    if scorer is not None:
        judged = _scored_rates(probes, candidates, references, keys, on, judge_threshold, transform, shortlist_k, scorer)
        out = join_on(out.drop(*[c for c in judged.columns if c not in on]), judged, on)
    recall = zero_if_null(F.try_divide(F.col("covered_count").cast("double"), F.col("reference_count")))
    precision = zero_if_null(F.try_divide(F.col("supported_count").cast("double"), F.col("source_count")))
    out = out.withColumns({"recall_rate": recall, "precision_rate": precision, "f1_score": harmonic(precision, recall)})
    return out.select(*on, "source_count", "reference_count", *METRICS, *PROFILE, *JUDGED)


def _whole_sets(candidates: DataFrame, references: DataFrame, runs: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Per run the cosine of both sides' summed vectors, and the Jaccard of their texts in small letters."""
    c = vector_sums(candidates, [*keys, "part"])
    c = vector_sums(join_on(c, runs, [*keys, "part"]).withColumnRenamed("total", "vec"), on)
    r = vector_sums(references, keys).withColumnRenamed("total", "_ref")
    cosine = zero_if_null(F.try_divide(vx.dot(F.col("total"), F.col("_ref")), F.sqrt(vx.dot(F.col("total"), F.col("total"))) * F.sqrt(vx.dot(F.col("_ref"), F.col("_ref")))))
    semantic = join_on(c, r, keys).select(*on, F.round(cosine, 4).alias("profile_semantic_similarity"), F.round(cosine, 4).alias("profile_average_semantic"))
    low = F.lower(F.coalesce("text", F.lit("")))
    said = join_on(candidates.select(*keys, "part", low.alias("text")).distinct(), runs, [*keys, "part"]).select(*on, "text", F.lit(1).alias("c"), F.lit(0).alias("r"))
    named = join_on(references.select(*keys, low.alias("text")).distinct(), runs.select(*on).distinct(), keys).select(*on, "text", F.lit(0).alias("c"), F.lit(1).alias("r"))
    texts = said.unionByName(named).groupBy(*on, "text").agg(F.max("c").alias("c"), F.max("r").alias("r"))
    jaccard = texts.groupBy(*on).agg(F.round(F.avg((F.col("c") * F.col("r")).cast("double")), 4).alias("profile_jaccard"))
    return join_on(semantic, jaccard, on)


def _scored_rates(probes, candidates, references, keys, on, threshold, transform, k, scorer) -> DataFrame:
    """Judge counts from scored texts: a row's shortlist are its nearest partners until ``k`` rows are reached, of either side."""
    near = probes.select(*on, "part", "id", "n", F.posexplode(F.sort_array("near", asc=False)).alias("_at", "_p"), F.sort_array("near", asc=False).alias("_all"))
    before = F.aggregate(F.slice("_all", 1, F.col("_at")), F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    near = near.where(before < k)
    is_ref = F.col("part") == REFERENCE
    listed = cut(near.select(*on, F.when(is_ref, F.col("_p.other")).otherwise(F.col("id")).alias("i"), F.when(is_ref, F.col("id")).otherwise(F.col("_p.other")).alias("j")).distinct())
    own = probes.where(~is_ref).select(*on, F.col("id").alias("i"), "part", F.col("n").alias("ni"))
    named = join_on(join_on(listed, own, [*on, "i"]), probes.where(is_ref).select(*on, F.col("id").alias("j"), F.col("n").alias("nj")), [*on, "j"])
    texts = named.select(*keys, "part", "i", "j").distinct()
    texts = join_on(texts, candidates.select(*keys, "part", F.col("id").alias("i"), F.col("text").alias("_a")), [*keys, "part", "i"])
    texts = join_on(texts, references.select(*keys, F.col("id").alias("j"), F.col("text").alias("_b")), [*keys, "j"])
    scores = cut(texts.select(*keys, "part", "i", "j", vx.score_transform(scorer(F.col("_b"), F.col("_a")), transform).alias("score")))
    scored = cut(join_on(named, scores, [*keys, "part", "i", "j"]))
    pairs = scored.groupBy(*on).agg(F.sum(F.col("ni") * F.col("nj")).alias("judge_pairs_scored"))
    rate = lambda side, n, hit, mean: scored.groupBy(*on, side).agg(F.max(n).alias("n"), F.max("score").alias("s")).groupBy(*on).agg(
        F.sum(F.when(F.col("s") >= threshold, F.col("n")).otherwise(0)).alias(hit), (F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias(mean))
    covered = rate("j", "nj", "covered_count", "mean_best_ref_to_pred_score")
    supported = rate("i", "ni", "supported_count", "mean_best_pred_to_ref_score")
    return join_on(join_on(pairs, covered, on), supported, on)


def evaluate_subsets(
    candidates: DataFrame, references: DataFrame, users: DataFrame, subsets: Sequence[str], arms: Mapping[str, Mapping], keys: Sequence[str],
    modalities: Sequence[str] = MODALITIES, embed: Callable[[Column], Column] | None = None, **options,
) -> DataFrame:
    """One wide row for every user of ``users``, modality subset (``mods``) and merge arm: status, counts before and after the merge,
    counts by modality, and everything ``compare_runs`` tells.

    ``candidates`` hold keys, modality, id, text, vec and, for the arms by time, t; ``references`` keys, id, text, vec. ``arms`` maps
    names of ``merge.ARMS`` to their options. Texts that an arm rewrites are embedded anew by ``embed``; without it the row keeps
    the vector of the text it stands for. Runs without references are ``missing_ideal``, those without candidates
    ``empty_candidate``; their metrics are null.
    """
    keys = list(keys)
    on = [*keys, "mods", "arm"]
    listed = F.array(*[F.lit(s) for s in subsets])
    fits = F.filter(listed, lambda s: F.array_contains(F.split(s, r"\+"), F.col("modality")))
    grid = users.select(*keys).distinct().withColumn("mods", F.explode(listed)).withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    parts, runs = [], []
    for arm, chosen in arms.items():
        if arm == "none":
            parts.append(candidates.select(*keys, F.col("modality").alias("part"), "id", "text", "vec"))
            members = grid.where(F.col("arm") == arm).withColumn("part", F.explode(F.split("mods", r"\+")))
            runs.append(members.select(*on, "part"))
            continue
        union = candidates.withColumn("mods", F.explode(fits)).drop("modality")
        merged = mg.run_arm(union, [*keys, "mods"], arm, **chosen).select(*keys, F.concat(F.lit(f"{arm}:"), "mods").alias("part"), "id", "text")
        known = candidates.select(*keys, "id", F.col("text").alias("_text"), F.col("vec").alias("_vec"))
        merged = join_on(merged, known, [*keys, "id"])
        vec = F.col("_vec") if embed is None else F.when(F.col("text").eqNullSafe(F.col("_text")), F.col("_vec")).otherwise(embed(F.col("text")))
        parts.append(merged.select(*keys, "part", "id", "text", vec.alias("vec")))
        runs.append(grid.where(F.col("arm") == arm).withColumn("part", F.concat(F.lit(f"{arm}:"), "mods")).select(*on, "part"))
    held = parts[0]
    for more in parts[1:]:
        held = held.unionByName(more)
    held = cut(held)
    table = runs[0]
    for more in runs[1:]:
        table = table.unionByName(more)
    measured = compare_runs(held, references, table, keys, ["mods", "arm"], **options)

    by_modality = candidates.withColumn("mods", F.explode(fits)).groupBy(*keys, "mods").agg(
        F.count(F.lit(1)).alias("candidate_count"), *[F.count_if(F.col("modality") == m).alias(f"count_{m}") for m in modalities])
    evaluated = join_on(table, held.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("_n")), [*keys, "part"]).groupBy(*on).agg(F.sum("_n").alias("eval_count"))
    ideals = references.groupBy(*keys).agg(F.count(F.lit(1)).alias("ideal_count"))
    out = join_on(join_on(join_on(grid, ideals, keys, "left"), by_modality, [*keys, "mods"], "left"), evaluated, on, "left")
    counts = ["ideal_count", "candidate_count", *[f"count_{m}" for m in modalities], "eval_count"]
    out = out.na.fill(0, counts).withColumn("status", run_status(F.col("candidate_count"), F.col("ideal_count")))
    out = out.withColumn("merge_absorbed", F.col("candidate_count") - F.col("eval_count"))
    return join_on(out, measured.drop("source_count", "reference_count"), on, "left")


def compare_with_baseline(
    users: DataFrame, baselines: DataFrame, folders: DataFrame, statements: DataFrame, keys: Sequence[str], **options,
) -> DataFrame:
    """One row for every user and reference folder: the user's baseline set (source) against the folder's (reference).

    ``baselines``: keys, source_model, source_file; ``folders``: keys, reference_model, mode, reference_file, any number a user;
    ``statements``: keys, model, id, text, vec. A user without folders has one row, ``missing_qwen_input``; a folder or baseline
    without a file gives ``missing_input`` with zero counts; all others are ``ok``, sets without statements with zero metrics.
    """
    keys = list(keys)
    on = [*keys, "reference_model"]
    names = users.select(*keys).distinct()
    grid = join_on(join_on(names, baselines.select(*keys, "source_model", "source_file"), keys, "left"), folders.select(*on, "mode", "reference_file"), keys, "left")
    status = baseline_status(F.when(F.col("source_file").isNull() | F.col("reference_file").isNull(), 0).otherwise(1), F.when(F.col("reference_model").isNull(), 0).otherwise(1))
    grid = cut(grid.withColumn("status", status))
    good = grid.where("status = 'ok'")
    of_model = statements.withColumnRenamed("model", "_model")
    sources = join_on(of_model, good.select(*keys, F.col("source_model").alias("_model")).distinct(), [*keys, "_model"], "left_semi").drop("_model")
    held = join_on(of_model, good.select(*keys, F.col("reference_model").alias("_model")).distinct(), [*keys, "_model"], "left_semi").withColumnRenamed("_model", "part")
    runs = good.select(*on, F.col("reference_model").alias("part"))
    found = compare_runs(held, sources, runs, keys, ["reference_model"], references_first=True, **options)
    # in compare_runs the folder is the source; here it is the reference
    swapped = {
        "source_to_reference_best_mean": "reference_to_source_best_mean", "reference_to_source_best_mean": "source_to_reference_best_mean",
        "soft_precision": "soft_recall", "soft_recall": "soft_precision",
        "soft_source_regions": "soft_reference_regions", "soft_reference_regions": "soft_source_regions",
    }
    found = found.select(*on, *[F.col(swapped.get(c, c)).alias(c) for c in [*METRICS, *PROFILE]])
    n_source = sources.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_count"))
    n_reference = held.groupBy(*keys, F.col("part").alias("reference_model")).agg(F.count(F.lit(1)).alias("reference_count"))
    out = join_on(join_on(join_on(grid, n_source, keys, "left"), n_reference, on, "left"), found, on, "left")
    ok = F.col("status") == "ok"
    out = out.withColumns({c: F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0) for c in ("source_count", "reference_count")})
    numbers = [*METRICS, *PROFILE[:-1]]
    out = out.withColumns({c: F.when(ok, zero_if_null(F.col(c))) for c in numbers})
    return out.withColumn("profile_interpretation", F.when(ok, F.coalesce("profile_interpretation", tx.score_label(F.lit(0.0)))))
