import numpy as np
import pytest

from daytrace.llm import quality, toxicity
from daytrace.llm.common import bounded_labels, fold_of
from daytrace.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name,label,least", [("op2_quality", "quality", 0.98), ("op4_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    got = QUERIES[name](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got[label]).mean() >= least
    assert got["score"].between(0, 1).all()


def test_cached_factors_give_the_gaussian_log_ratio():
    rng = np.random.default_rng(1)
    d = len(quality.NAMES)
    x, y = np.vstack([rng.normal(0, 1, (200, d)), rng.normal(0.5, 2, (200, d))]), np.repeat([0, 1], 200)
    model = quality.fit(x, y)
    z = (x[:5] - model.centre) / model.scale
    logs = []
    for mean, factor, offset in zip(model.means, model.factors, model.offsets):
        cov = factor @ factor.T
        prior = offset + np.log(np.diag(factor)).sum()
        logs.append(prior - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean))
    assert np.allclose(model.score(x[:5]), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_isotonic_is_the_best_rising_fit():
    knots, values = toxicity.isotonic(np.array([1.0, 2, 3, 3, 4]), np.array([0, 1, 0, 0, 1]))
    assert np.all(np.diff(values) >= 0) and np.interp(3, knots, values) == pytest.approx(1 / 3) and np.interp(4, knots, values) == 1


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    assert ((toxicity.boost(x, y).margin(x) > 0) == y).mean() > 0.95


def test_obfuscated_and_directed_words_are_seen():
    reader = toxicity.Reader(frozenset({"idio", "idiot"}))
    plain, hidden = reader.features("you idiot there"), reader.features("you 1d.i0t there")
    assert plain[0] == hidden[0] > 0 and plain[3] == hidden[3] == 1 and hidden[2] > 0 == plain[2]


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_empty_tables_are_scored(spark, module, label):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "fine words here. " * 3000, 2), (2, "!!! ### $$$", 3)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    some = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (9, None)], f"doc_id long, {label} int")
    for labels in (none, some):
        got = docs.select("doc_id", module.score_column("text", module.train(docs, labels, label)).alias("s")).collect()
        assert len(got) == 4 and all(0 <= r.s <= 1 for r in got)
    assert docs.limit(0).select(module.score_column("text", module.train(docs.limit(0), none, label))).count() == 0


def test_sample_is_bounded_and_ignores_nulls(spark):
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as quality")
    got = bounded_labels(labels, "quality", 1000).groupBy("y").count().collect()
    assert all(r["count"] == pytest.approx(500, rel=0.2) for r in got)


def test_held_out_labels_are_not_learned_from(spark):
    assert spark.range(50).where(fold_of("id", 5) != 0).count() < 50


def test_common_word_counts_over_the_whole_text():
    clean, at = " ".join(f"w{k}" for k in range(200)), quality.NAMES.index("common_word")
    stuffed = quality.statistics(clean + " buy" * 1800)[at]
    assert stuffed == pytest.approx(np.log(1800.5 / 2001)) and stuffed > quality.statistics(clean)[at]
    assert quality.statistics("buy " * 200 + " ".join(f"w{k}" for k in range(1800)))[at] == pytest.approx(np.log(200.5 / 2001))
