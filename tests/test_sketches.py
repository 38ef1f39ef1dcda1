"""Two-stage clusters: bounds from bit sketches of texts decide most pairs without their texts."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from daytrace.operators import infer as nf
from daytrace.operators import merge as mg
from daytrace.operators.infer import lexical_score


def test_bounds_hold_the_score(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(4000)]
    odds = 1 / np.arange(1, 4001)
    texts = [" ".join(rng.choice(words, n, p=odds / odds.sum())) for n in rng.integers(0, 900, 80)] + ["", None, "w1", "w3999 w3998", "a . b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("words", nf.lexical_words(F.col("text")))
    common = nf.common_words(df)
    got = df.select("id", F.size("words").alias("n"), nf.lexical_sketch(F.col("words"), common).alias("bits")).orderBy("id").collect()
    sizes, bits = np.array([r["n"] for r in got], float), np.stack([np.frombuffer(r["bits"], np.uint64) for r in got])
    x, y = np.triu_indices(len(texts))
    least, most = nf.lexical_bounds(sizes[x], bits[x], sizes[y], bits[y])
    sets = [{w for w in (t or "").split() if len(w) > 1} for t in texts]
    exact = np.array([len(sets[a] & sets[b]) / max(len(sets[a] | sets[b]), 1) for a, b in zip(x, y)])
    assert len(common) == nf.COMMON_WORDS and (least <= exact).all() and (exact <= most).all()
    assert (least > 0).mean() > 0.5 and (most < 0.9 * least.max()).any()


@pytest.mark.parametrize("block_rows", [20, 2_048])
def test_clusters_equal_brute_force_and_few_pairs_are_scored(spark, block_rows):
    rng = np.random.default_rng(5)
    theta, tau, n = 0.5, 0.1, 240
    vocabulary = [f"w{k}" for k in range(1500)]
    out = []
    for i in range(n):
        v = rng.normal(size=4)
        text = [" ".join(rng.choice(vocabulary[:40] if i % 3 else vocabulary, 25)), f"x{i} y{i}", "", None][0 if i % 8 < 6 else 1 if i % 8 == 6 else 2 + i % 2]
        out.append((None if i % 5 == 0 else "a", i, text, (v / np.linalg.norm(v)).astype(np.float32).tolist()))
    out += [(k, n + i, t, v) for k, i, t, v in out[:30]]  # copies
    df = spark.createDataFrame(out, "user string, id long, text string, vec array<float>")
    want, similar = {r[1]: r[1] for r in out}, 0
    sets, vecs = [{w for w in (r[2] or "").split() if len(w) > 1} for r in out], np.array([r[3] for r in out], float)
    for a in range(len(out)):
        for b in range(a + 1, len(out)):
            if out[a][0] == out[b][0] and vecs[a] @ vecs[b] >= theta:
                similar += 1
                if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= tau:
                    x, y = want[a], want[b]
                    want = {k: min(x, y) if c in (x, y) else c for k, c in want.items()}
    scored = []
    edges, tagged = mg.merge_edges(df, ["user"], theta, lexical_score, tau, block_rows=block_rows, scored=scored)
    assert {r["id"]: r["cluster"] for r in mg.cluster_members(tagged, edges, ["user"]).collect()} == want
    assert sum(scored) < similar / 20
    found = mg.cluster_reduce(df, ["user"], theta, lexical_score, tau, block_rows=block_rows)
    sizes = {c: list(want.values()).count(c) for c in set(want.values())}
    assert {r["cluster"]: r["size"] for r in found.collect()} == sizes
    assert {(r["id"], r["text"]) for r in found.collect()} <= {(r[1], r[2]) for r in out}


def test_a_key_without_words_or_rows(spark):
    shape = "user string, id long, text string, vec array<float>"
    bare = spark.createDataFrame([("a", 1, "", [1.0]), ("a", 2, None, [1.0]), ("b", 3, "- .", [1.0])], shape)
    assert rows(mg.cluster_reduce(bare, ["user"], 0.5, lexical_score, 0.1), "cluster", "size") == [(1, 1), (2, 1), (3, 1)]
    assert rows(mg.cluster_reduce(bare, ["user"], 0.5, lexical_score, 0.0), "cluster", "size") == [(1, 2), (3, 1)]
    assert mg.cluster_reduce(bare.limit(0), ["user"], 0.5, lexical_score, 0.1).count() == 0
