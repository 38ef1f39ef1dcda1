import re

import corpus_pipeline as pipeline
import pytest

from daytrace.session import cut

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        docs.append(cut(stage(spark, docs[-1], SF)))
    return docs


def test_each_stage_keeps_some_rows_of_its_input_with_their_columns(steps):
    for before, after in zip(steps[:4], steps[1:5]):
        assert after.columns == steps[0].columns
        assert 0 < after.count() < before.count() and after.exceptAll(before).count() == 0


def test_rejected_documents_are_the_labelled_ones(spark, steps):
    """A few hundred labels are few to learn from: a fifth of the bad documents may pass here, but clean ones stay."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, bad in ((1, "quality = 0"), (2, "toxic = 1")):
        before = steps[k - 1].join(labels, "doc_id")
        passed = steps[k].join(labels, "doc_id").where(bad).count()
        lost = before.where(f"not ({bad})").join(steps[k].select("doc_id"), "doc_id", "left_anti").count()
        assert passed <= 0.2 * before.where(bad).count() and lost <= 0.01 * before.where(f"not ({bad})").count()


def test_one_of_each_group_stays(steps):
    from test_similarity_and_leaks import brute

    before = sorted((r.doc_id, r.text) for r in steps[2].collect())
    _, roots = brute([t for _, t in before])
    groups = {}
    for (doc, _), root in zip(before, roots):
        groups.setdefault(root, set()).add(doc)
    kept = {r.doc_id for r in steps[3].collect()}
    assert all(len(kept & g) == 1 for g in groups.values())


def test_leaking_documents_go_and_others_stay(spark, steps):
    norm = lambda s: " ".join(re.findall(r"\w+", s.lower()))
    items = [norm(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r.doc_id for r in steps[3].collect() if not any(t in norm(r.text) for t in items)}
    assert {r.doc_id for r in steps[4].collect()} == want


def test_texts_come_back_from_their_ids(steps):
    assert steps[5].count() == steps[4].count() == steps[5].where("round_trip").count()
