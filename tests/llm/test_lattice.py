import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from daytrace.llm import lattice  # noqa: E402

PATH = P.path("piece_bpe_32k.model")


def sums(pieces, text):
    """Probability of ``text`` by listing every segmentation."""
    return 1.0 if not text else sum(w * sums(pieces, text[len(p) :]) for p, w in pieces.items() if text.startswith(p))


@pytest.fixture(scope="module")
def small():
    weights = {b" ": 0.2, b"a": 0.2, b"b": 0.1, b"ab": 0.2, b" a": 0.2, b"aba": 0.1}
    return weights, lattice.Lattice(list(weights), np.array(list(weights.values())))


@pytest.mark.parametrize("word", [b"a", b"ab", b"abab", b"aabba", b"babaab"])
def test_forward_sum_is_over_all_segmentations(small, word):
    weights, own = small
    assert own.log_probability(word) == pytest.approx(math.log(sums(weights, b" " + word)))


def test_expected_counts_spell_the_word(small):
    weights, own = small
    into = np.zeros(len(weights))
    own.expected(b"abab", 3.0, into)
    assert sum(n * len(p) for p, n in zip(weights, into)) == pytest.approx(3.0 * 5)


def test_a_long_word_is_one_lattice(small):
    weights, own = small
    word = b"aba" * 3334
    text, chance, down = b" " + word, [1.0], 0.0  # plain sums over the whole word, scaled at each place
    for end in range(1, len(text) + 1):
        total = sum(w * chance[-len(p)] for p, w in weights.items() if len(p) < end + 1 and text[end - len(p) : end] == p)
        down += math.log(total)
        chance = [c / total for c in [*chance, total][-3:]]
    assert own.log_probability(word) == pytest.approx(down, rel=1e-12)
    into = np.zeros(len(weights))
    own.expected(word, 2.0, into)
    assert sum(n * len(p) for p, n in zip(weights, into)) == pytest.approx(2.0 * len(text))
    step = {p: (own.log_probability(word), math.log(w)) for p, w in weights.items()}
    for k, (p, (base, _)) in enumerate(step.items()):  # expected uses are the slope of the log chance in the log weight
        bent = lattice.Lattice(list(weights), np.array([w * (1.00001 if q == p else 1) for q, w in weights.items()]))
        assert 2.0 * (bent.log_probability(word) - base) / math.log(1.00001) == pytest.approx(into[k], rel=1e-3)


def test_vocabulary_is_a_distribution_with_every_byte():
    vocab = dict(lattice.vocabulary(PATH))
    assert sum(vocab.values()) == pytest.approx(1) and all(bytes([b]) in vocab for b in range(256))


@pytest.mark.parametrize("common", [0, 3, 10_000])
def test_scores_equal_a_plain_computation(spark, common):
    texts = ["the cat The CAT\tsat", None, "", "new wörd", "the the the mat " * 30, "x" * 2000, "the cat"]
    rows = [(k, t, "n", 1.0) for k, t in enumerate([*texts, *texts])] + [(None, "null id the", "n", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, score double").repartition(3)
    learn = F.crc32(F.col("doc_id").cast("string")) % 10 > 2
    got = lattice.score(df, learn, PATH, common=common).collect()
    assert len(got) == len(rows)
    use = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 > 2
    seen = Counter()
    for i, t, *_ in rows:
        if use(i):
            seen.update([*(t or "").encode().lower().split(), None])
    n, v = sum(seen.values()), len(seen)
    by_id = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        r = by_id[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.learned) == (len(tokens), sum(seen[w] > 0 for w in tokens), n, use(i))
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_word_chances_sum_to_at_most_one(spark):
    df = spark.createDataFrame([(1, "a b a b c"), (2, "a d")], "doc_id long, text string")
    one = spark.createDataFrame([(k, w) for k, w in enumerate(["a", "b", "c", "d", "e", "zz", ""])], "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 10)
    got = {r.doc_id: r.score for r in lattice.score(df.unionByName(one), F.col("doc_id") < 10, PATH).collect()}
    end = 10 ** got[16]
    assert sum(10 ** got[k] / end for k in range(10, 16)) + end <= 1


def test_nothing_to_learn_from_and_no_rows(spark):
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.score(df, F.lit(False), PATH).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].score < got[2].score < 0
    assert lattice.score(df.limit(0), F.lit(True), PATH).count() == 0


def test_words_together_equal_words_alone(small):
    weights, own = small
    words = [b"a", b"ab", b"abab", b"aabba", b"babaab", b"ab", b"ba" * 300, b""]
    assert own.log_probabilities(words) == pytest.approx([own.log_probability(w) for w in words])
    alone, joint = np.zeros(len(weights)), np.zeros(len(weights))
    for k, w in enumerate(words):
        own.expected(w, k + 0.5, alone)
    own.expected_uses(words, lambda part, chance: np.array(part) + 0.5, joint)
    assert joint == pytest.approx(alone)


def test_own_arcs_settle_where_steps_would():
    counts, chance, spread, known = np.array([1.0, 2.0, 50.0, 3.0, 1.0]), np.log([1e-9, 1e-4, 1e-3, 0.2, 0.4]), 0.3, 1000
    got, steps = lattice.own_uses(counts, chance, spread, known, 0.75), counts - 0.75
    for _ in range(5000):
        steps = np.maximum(counts * steps / (steps + np.exp(chance) * spread * known) - 0.75, 0)
    assert got == pytest.approx(steps, abs=1e-6) and got[2] > 0 and got[4] == 0


def test_score_is_the_marginal_over_pieces_and_word_arcs(spark, monkeypatch):
    """The whole model again in plain Python over listed segmentations: expectation steps, discounted word arcs, texts."""
    pieces = {b" ": 0.2, b"a": 0.2, b"b": 0.1, b"ab": 0.2, b" a": 0.2, b"aba": 0.1}
    monkeypatch.setattr(lattice, "vocabulary", lambda path: tuple(pieces.items()))
    texts = {1: "ab ab aba b", 2: "ab a ABA bb", 3: "ab ab ab", 4: "abb ab", 5: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in lattice.score(df, F.col("doc_id") < 4, "any").collect()}

    def cuts(text):
        return [[]] if not text else [[p, *rest] for p in pieces if text.startswith(p) for rest in cuts(text[len(p) :])]

    words = lambda t: (t or "").lower().encode().split()
    seen = Counter(w for k, t in texts.items() if k < 4 for w in words(t))
    known, ends = sum(seen.values()), 3
    weight, spread, before = dict(pieces), 0.6 * len(seen) / known, None  # three words once, one twice
    chance = lambda w: sum(math.prod(weight[p] for p in c) for c in cuts(b" " + w))

    def arc(w):
        return float(lattice.own_uses(np.array([seen[w]], float), np.log([chance(w)]), spread, known, 0.6)[0])

    for _ in range(lattice.STEPS):
        sums, uses, now = {p: lattice.PRIOR_PIECES * v for p, v in pieces.items()}, 0.0, 0.0
        for w, c in seen.items():
            uses += arc(w)
            now += c * math.log(arc(w) / known + chance(w) * spread)
            for way in cuts(b" " + w):
                for p in way:
                    sums[p] += (c - arc(w)) * math.prod(weight[q] for q in way) / chance(w)
        weight, spread = {p: v / sum(sums.values()) for p, v in sums.items()}, 1 - uses / known
        if before is not None and abs(now - before) <= lattice.SETTLED * abs(before):
            break
        before = now
    arcs = {w: arc(w) for w in seen}
    rest, end = 1 - sum(arcs.values()) / known, (ends + 1) / (known + ends + 2)
    for k, t in texts.items():
        expect = math.log10(end) + sum(math.log10((1 - end) * (arcs.get(w, 0) / known + rest * chance(w))) for w in words(t))
        assert got[k] == pytest.approx(expect)
