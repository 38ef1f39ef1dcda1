"""From documents to token ids: quality, toxicity, near-duplicates, benchmark leaks, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and gives a DataFrame; all but the last
return the columns of documents. ``run`` writes each result to the shared folder and reads it again for the next stage.
Null and empty texts pass the stages as empty texts; rows with equal or null ids are judged one by one. The stages that work in
Python lower the session's Arrow batches to a thousand rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from daytrace.llm import bpe, decontaminate, ngram_join, quality, toxicity
from daytrace.llm.common import fold_of, fresh_name, long_rows, table, text_or_empty
from daytrace.session import cut

REJECT_QUALITY_BELOW = 0.3
REJECT_TOXICITY_FROM = 0.3
ORACLE_SQL = None  # learned scores, MinHash and BPE merges have no SQL form; tests compare with brute force


def _kept(docs: DataFrame, score: Column, keep) -> DataFrame:
    long_rows(docs.sparkSession)
    name = fresh_name(docs, "stage_score")
    return docs.withColumn(name, score).where(keep(F.col(name))).drop(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of the given documents outside its
    held-out fold."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0))
    return _kept(docs, quality.score_column("text", model), lambda s: s >= REJECT_QUALITY_BELOW)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject, learned likewise."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold_of("doc_id", 4) != 2))
    return _kept(docs, toxicity.score_column("text", model), lambda s: s < REJECT_TOXICITY_FROM)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are linked by n-gram similarity; documents without words all stay."""
    return ngram_join.join(docs).where(ngram_join.keep_one()).select("row.*")


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (four little-endian bytes an id), their number, and whether decoding gives the text back."""
    long_rows(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = docs.select("doc_id", "lang", "source", text_or_empty().alias("text"), bpe.encode_column(text_or_empty(), path, pattern).alias("ids"))
    whole = bpe.decode_column("ids", path, pattern) == F.col("text").cast("binary")
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", duplicates_stage),
    ("decontamination", leaks_stage),
    ("byte_bpe", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
