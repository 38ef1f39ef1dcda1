import random
import re

import numpy as np
import pandas as pd
import pytest

from daytrace.llm import decontaminate, ngram_join
from daytrace.llm.queries import QUERIES


def grams(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(n, len(w))
    return frozenset(zip(*[w[i : len(w) - n + 1 + i] for i in range(n)])) if n else frozenset()


def brute(texts, threshold=0.8):
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(texts)
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return links, [find(k) for k in range(len(texts))]


def made(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "...", "one two", "one two", "One, two!"]
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([8, 60, 300]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 9])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("options", [{}, {"block_rows": 2}, {"block_grams": 50, "broadcast_rows": 0}])
def test_join_equals_brute_force(spark, options):
    texts = made()
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, key string, links int").coalesce(1)
    got = {r.row.doc_id: (r.links, r["class"], r.key) for r in ngram_join.join(df, **options).collect()}
    links, roots = brute(texts)
    by_key = {k: i for i, (_, _, k) in got.items()}
    assert [got[i][0] for i in range(len(texts))] == links
    assert [by_key[got[i][1]] for i in range(len(texts))] == roots


def test_join_of_nothing(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shared_grams_of_dense_and_rare_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60))).astype(np.uint64) for _ in range(70)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = ngram_join.shared_grams(sets)
    np.fill_diagonal(got, 0), np.fill_diagonal(want, 0)
    assert (got == want).all()


@pytest.mark.parametrize("k", [1, 2, 11, 21, 300, 1999])
def test_ties_at_the_threshold_are_links(k):
    def links(shared, left, right):
        a, b = np.arange(shared + left), np.r_[np.arange(shared), np.arange(right) + 10**6]
        group = pd.DataFrame({"grams": [s.astype(np.uint64).tobytes() for s in (a, b)], "key": [3, 5], "copies": [1, 1], "block": 0, "bi": 0, "bj": 0})
        return ngram_join.verify(group, 0.8)["links"].tolist()

    assert links(4 * k, k - k // 2, k // 2) == [1, 1]
    assert links(4 * k, k - k // 2 + 1, k // 2) == links(4 * k - 1, k + 1, 0) == [0, 0]


@pytest.mark.parametrize("keys", [[1, 3, 4, 2], [5, 1, 2, 6, 3, 4], list(range(9, 0, -1))])
def test_chains_of_links_hold_together(spark, keys):
    sets = [np.arange(10 * t, 10 * t + 90).astype(np.uint64).tobytes() for t in range(len(keys))]  # each is linked with the next only
    group = pd.DataFrame({"grams": sets, "key": keys, "copies": 1, "block": 0, "bi": 0, "bj": 0})
    got = ngram_join.verify(group, 0.8)
    assert got["tie"].tolist() == [min(keys)] * len(keys) and got["links"].tolist() == [1, *[2] * (len(keys) - 2), 1]
    words = [" ".join(f"w{k}" for k in range(10 * t, 10 * t + 94)) for t in range(len(keys))]
    df = spark.createDataFrame(sorted(zip(keys, words)), "doc_id long, text string").coalesce(1)
    assert len({r["class"] for r in ngram_join.join(df).collect()}) == 1


def test_bands_reach_the_recall():
    b = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8**ngram_join.BAND_ROWS) ** b >= 0.999


def test_documents_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    links, roots = brute([t for _, t in docs])
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op7_ngram_join"](spark, sf).collect()}
    assert got == {d: (docs[roots[k]][0], links[k]) for k, (d, _) in enumerate(docs)}


ITEM = "The shop sold 12 apples to Mary and then 12 more apples to the man with Mary on Friday for 3 kg"


def found(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, hash int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    keyed = docs.select("doc_id", *decontaminate.text_key(docs.text))
    rows = decontaminate.leaks(docs, bench, **options).join(keyed, decontaminate.KEY)
    kept = {r.doc_id for r in decontaminate.without_leaks(docs, bench, **options).collect()}
    got = {(r.doc_id, r.item): r.kind for r in rows.collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}
    return got


@pytest.mark.parametrize("options", [{}, {"broadcast_windows": 0}])
def test_slots_have_to_agree(spark, options):
    changed = ITEM.replace("12", "15").replace("Mary", "Anna").replace("3 kg", "4 lb")
    texts = [ITEM, "Before it. " + changed + ". After.", changed.replace("15 more", "16 more"), changed.replace("with Anna", "with Ruth"), None, "", ITEM, "word " * 20_000, "a short one here"]
    got = found(spark, texts, [ITEM, "short one here", None, ""], **options)
    assert got == {(0, 0): "verbatim", (1, 0): "reparameterised", (6, 0): "verbatim", (8, 1): "verbatim"}


def test_first_words_and_conflicts_hide_no_leak(spark):
    paris, tom = "Paris is the capital of France", "Tom has 3 apples. Tom buys 4 more. How many apples does Tom have?"
    long = "one two three four five six seven eight nine ten eleven twelve 12 thirteen fourteen fifteen 12 sixteen"
    texts = [f"as we know {paris} today", tom.replace("Tom", "Anna"), long.replace("fifteen 12", "fifteen 13"), "a paris is the capital of france", "Nothing is the capital of Nowhere", "so a short thing", "A short thing", "My short thing"]
    items = [paris, tom, long, "a short thing"]
    assert found(spark, texts, items) == {(0, 0): "verbatim", (1, 1): "reparameterised", (2, 2): "verbatim", (3, 0): "verbatim", (4, 0): "reparameterised", (5, 3): "verbatim", (6, 3): "verbatim"}


def test_windows_without_words_are_no_evidence(spark):
    """Slots alone know no question again: other figures, units and title-case lines are left alone, the same ones are found."""
    title = "The Quick Brown Fox Jumps Over Lazy Dogs"
    texts = ["please buy 7 lb there", "please buy 5 kg there", "A Great New Song About Seven Small Birds", "so it is: " + title]
    assert found(spark, texts, ["5 kg", title]) == {(1, 0): "verbatim", (3, 1): "verbatim"}


def test_hashes_of_windows_are_the_same_both_ways(spark):
    df = spark.createDataFrame([("Tom has 3 apples and Mary has 4 kg more of them today",), ("one two",), ("",)], "t string")
    full = decontaminate.slotted(df.t)
    row = df.select(decontaminate.windows(full, [3, 8]).alias("w"), decontaminate.window_hashes(full, [3, 8]).alias("h")).collect()
    assert [[w.hash for w in r.w] for r in row] == [list(r.h) for r in row] and len(row[0].h) == 11 + 6


def test_empty_tables(spark):
    assert found(spark, ["some text"], []) == {}
    assert found(spark, [], [ITEM]) == {}


def test_whole_passages_are_found_and_no_others(spark):
    sf = "/root/testdata/sf0.01"
    norm = lambda s: " ".join(re.findall(r"\w+", s.lower()))
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, t in items if t in norm(r.text)}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op8_template_leaks"](spark, sf).collect()} == want
