"""Iterative graph steps on edge tables: components, ordered independent sets, greedy matching.

Each round is a join and an aggregation; its result is written to the shared scratch folder, so rounds do
not pile up lineage and survive lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from daytrace.functions.common import join_on
from daytrace.session import cut, cut_counted

# Graphs, or what rounds have left of them, with at most this many edges are finished by one ordered pass.
FOLD_EDGES = 200_000


def _per_key(rows: DataFrame, keys: list[str], by: list[str], fn, schema) -> DataFrame:
    """Grouped pass over rows whose number has been checked; one group when there are no keys."""
    if keys or by:
        return rows.groupBy(*keys, *by).applyInPandas(fn, schema)
    return rows.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda pdf: fn(pdf.drop(columns="_g")), schema)


def connected_components(edges: DataFrame, keys: Sequence[str] = (), fold_edges: int = FOLD_EDGES) -> DataFrame:
    """Every node of ``edges(i, j)`` with ``component`` = its smallest reachable id, per key.

    Graphs above ``fold_edges`` edges run in rounds: alternates the large-star and small-star steps (Kiveris et al., 2014): each replaces edges by edges to a
    neighbourhood minimum until only stars remain, in about log²(n) rounds whatever the diameter.
    """
    keys = list(keys)
    on_u = [*keys, "u"]

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            around = pairs.unionByName(pairs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            around = pairs.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = around.groupBy(*on_u).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        near = join_on(around, low, on_u)
        if large:
            out = near.where(F.col("v") > F.col("u")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = near.where(F.col("v") != F.col("m")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            out = out.unionByName(low.select(*keys, "u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    def written(pairs: DataFrame) -> tuple[DataFrame, dict]:
        """The edges, written, and a fingerprint of them observed during that same write."""
        mark = Observation()
        size, mix = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)")).alias("h")
        return cut(pairs.observe(mark, size, mix)), mark.get

    current, seen = written(
        edges.where(F.col("i") != F.col("j"))
        .select(*keys, F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).distinct()
    )
    if seen["n"] <= fold_edges:
        id_type = edges.schema["i"].dataType.simpleString()
        names = [f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys]

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            root: dict = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in zip(pdf["u"], pdf["v"]):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            out = pd.DataFrame({"id": list(root), "component": [find(x) for x in list(root)]})
            for k in keys:
                out[k] = pdf[k].iloc[0]
            return out[[*keys, "id", "component"]]

        return _per_key(current, keys, [], fold, ", ".join([*names, f"id {id_type}", f"component {id_type}"]))
    while seen["n"]:
        current, now = written(stars(stars(current, large=True), large=False))
        if now == seen:
            break
        seen = now
    members = current.select(*keys, F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(*keys, F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _cut_counting(df: DataFrame, condition) -> tuple[DataFrame, int]:
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(condition).alias("n")))
    return out, seen.get["n"]


def _components_by_size(edges: DataFrame, keys: Sequence[str], limit: int):
    """Edges with their component, split into those of components with at most ``limit`` edges and the rest."""
    comp = connected_components(edges, keys).withColumnRenamed("id", "i")
    tagged = join_on(edges, comp, [*keys, "i"])
    sizes = tagged.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_m"))
    tagged = join_on(tagged, sizes, [*keys, "component"])
    return tagged.where(F.col("_m") <= limit).drop("_m"), tagged.where(F.col("_m") > limit).drop("_m", "component")


def first_come_set(
    edges: DataFrame, keys: Sequence[str] = (), rounds_before_fold: int = 6, fold_edges: int = FOLD_EDGES
) -> DataFrame:
    """Who survives a first-come gate: a node is kept unless an earlier kept neighbour blocks it.

    ``edges(i, j)`` say that ``i`` comes before ``j`` in processing order (any sortable ids).  Returns every
    node of the edges with ``kept``.  This equals the sequential pass, but runs in rounds: a node without
    undecided earlier neighbours is kept, its later neighbours drop out, and their edges go with them.  What
    is left after a few rounds is split into components, small ones are finished by an ordered pass each,
    and only larger ones go on in rounds.
    """
    keys = list(keys)
    on_i, on_j = [*keys, "i"], [*keys, "j"]
    todo, n = cut_counted(edges.select(*keys, "i", "j").distinct())
    decided: list[DataFrame] = []
    names = [f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys]
    id_type = edges.schema["i"].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: dict = {}
        for j, group in pdf.sort_values(["j", "i"]).groupby("j", sort=True):
            for i in group["i"]:
                if i not in kept:
                    kept[i] = True  # no earlier neighbour at all
            kept[j] = not any(kept[i] for i in group["i"])
        out = pd.DataFrame({"id": list(kept), "kept": list(kept.values())})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "id", "kept"]]

    schema = ", ".join([*names, f"id {id_type}", "kept boolean"])
    while n > fold_edges:
        for _ in range(rounds_before_fold):
            blocked = todo.select(*keys, F.col("j").alias("i")).distinct().withColumn("_b", F.lit(True))
            marked = join_on(todo, blocked, on_i, "left").select(*keys, "i", "j", F.col("_b").isNull().alias("free_i"))
            lost = marked.groupBy(*on_j).agg(F.bool_or("free_i").alias("lost_j"))
            lost_as_i = lost.select(*keys, F.col("j").alias("i"), F.col("lost_j").alias("lost_i"))
            marked = join_on(join_on(marked, lost, on_j), lost_as_i, on_i, "left").na.fill(False, ["lost_i"])
            open_edge = F.expr("not free_i and not lost_j and not lost_i")
            marked, n = _cut_counting(marked, open_edge)
            decided.append(marked.where("free_i").select(*keys, F.col("i").alias("id"), F.lit(True).alias("kept")))
            # a node not lost whose earlier neighbours are all lost is kept
            fate = marked.groupBy(*on_j).agg(F.bool_or("lost_j").alias("_l"), F.bool_and("lost_i").alias("_a"))
            decided.append(fate.where("_l or _a").select(*keys, F.col("j").alias("id"), (~F.col("_l")).alias("kept")))
            todo = marked.where(open_edge).select(*keys, "i", "j")
            if n <= fold_edges:
                break
        else:
            small, large = _components_by_size(todo, keys, fold_edges)
            decided.append(cut(small.groupBy(*keys, "component").applyInPandas(fold, schema)))
            todo, n = cut_counted(large)
            if not n:
                break
    if n:
        decided.append(_per_key(todo, keys, [], fold, schema))
    if not decided:
        return edges.select(*keys, F.col("i").alias("id"), F.lit(True).alias("kept")).limit(0)
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.distinct()


def greedy_matching(
    pairs: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str] = (), score: str = "cos",
    rounds_before_fold: int = 6, fold_edges: int = FOLD_EDGES,
) -> DataFrame:
    """One-to-one matching that takes pairs by (score, i, j) descending while both ends are free.

    ``left``/``right`` give every ``id`` its number of copies ``n``; a pair is taken ``m`` = the smaller
    remaining number of times, which is what a pass over all single copies does.  A pair that is the best of
    both its ends is always next for both, so a round takes all such pairs at once; what is left after some
    rounds is finished component by component, and only large components go on in rounds.
    """
    keys = list(keys)
    rank = F.struct(score, "i", "j")
    on_i, on_j = [*keys, "i"], [*keys, "j"]
    cap_l = left.select(*keys, F.col("id").alias("i"), F.col("n").cast("bigint").alias("ni"))
    cap_r = right.select(*keys, F.col("id").alias("j"), F.col("n").cast("bigint").alias("nj"))
    todo, n = cut_counted(join_on(join_on(pairs.select(*keys, "i", "j", score), cap_l, on_i), cap_r, on_j).select(*keys, "i", "j", score, "ni", "nj"))
    taken: list[DataFrame] = []
    out_cols = [*keys, "i", "j", score, "m"]
    schema = todo.select(*keys, "i", "j", score, F.col("ni").alias("m")).schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, left_n, right_n = [], {}, {}
        for row in pdf.sort_values([score, "i", "j"], ascending=False).itertuples(index=False):
            m = min(left_n.setdefault(row.i, row.ni), right_n.setdefault(row.j, row.nj))
            if m:
                left_n[row.i] -= m
                right_n[row.j] -= m
                rows.append([*(getattr(row, k) for k in keys), row.i, row.j, getattr(row, score), m])
        return pd.DataFrame(rows, columns=out_cols)

    while n > fold_edges:
        for _ in range(rounds_before_fold):
            by_i = todo.groupBy(*on_i).agg(F.max(rank).alias("_b")).select(*keys, "_b.i", "_b.j")
            by_j = todo.groupBy(*on_j).agg(F.max(rank).alias("_b")).select(*keys, "_b.i", "_b.j")
            won = join_on(todo, join_on(by_i, by_j, [*keys, "i", "j"]), [*keys, "i", "j"]).withColumn("m", F.least("ni", "nj"))
            taken.append(won.select(*out_cols))
            rest = (
                join_on(
                    join_on(todo, won.select(*on_i, F.col("m").alias("_mi")), on_i, "left"),
                    won.select(*on_j, F.col("m").alias("_mj")), on_j, "left",
                )
                .withColumn("ni", F.col("ni") - F.coalesce("_mi", F.lit(0)))
                .withColumn("nj", F.col("nj") - F.coalesce("_mj", F.lit(0)))
                .where("ni > 0 and nj > 0").select(*todo.columns)
            )
            todo, n = cut_counted(rest)
            if n <= fold_edges:
                break
        else:
            # the two sides are different sets, so their ids must not meet inside one component
            tagged = todo.withColumn("_i", F.concat(F.lit("l"), F.col("i").cast("string"))).withColumn(
                "_j", F.concat(F.lit("r"), F.col("j").cast("string")))
            comp = connected_components(tagged.select(*keys, F.col("_i").alias("i"), F.col("_j").alias("j")), keys)
            tagged = join_on(tagged, comp.withColumnRenamed("id", "_i"), [*keys, "_i"])
            sizes = tagged.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_m"))
            tagged = join_on(tagged, sizes, [*keys, "component"])
            small = tagged.where(F.col("_m") <= fold_edges)
            taken.append(cut(small.groupBy(*keys, "component").applyInPandas(fold, schema)))
            todo, n = cut_counted(tagged.where(F.col("_m") > fold_edges).select(*todo.columns))
            if not n:
                break
    if n:
        taken.append(_per_key(todo, keys, [], fold, schema))
    if not taken:
        return todo.withColumn("m", F.col("ni")).select(*out_cols)
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out
