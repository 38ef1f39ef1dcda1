"""Registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

import corpus_pipeline
from daytrace.llm import bpe, chat, codebooks, decontaminate, lattice, licenses, ngram_join, quality, rabitq, simhash, token_counts, toxicity, whitening
from daytrace.llm.common import fold_of, join_counted, long_rows, table, text_or_empty
from daytrace.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_rows(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe.coded_column(text_or_empty(), path, pattern).alias("c"))
    return coded.select(
        "doc_id",
        (F.octet_length("c.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("c.ids", 256).alias("ids_sha256"),
        F.sha2("c.decoded", 256).alias("decoded_sha256"),
    )


def _scored(spark: SparkSession, sf_dir: str, module, label: str, folds: int, held: int) -> DataFrame:
    """Scores of all documents by a model of ``module`` that has learned from the labels outside one fold."""
    long_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", folds) != held)
    model = module.train(docs, labels, label)
    return docs.select(
        "doc_id",
        F.coalesce(fold_of("doc_id", folds) == held, F.lit(True)).alias("held_out"),
        module.score_column("text", model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality", 5, 0)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", 4, 2)


@query
def op5_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    long_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    n = token_counts.count_column("text", public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n.alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


@query
def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_rows(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lattice.score(docs, fold_of("doc_id", 10) != 0, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    events = said.unionByName(extra).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn").alias("message"), "role", "text")
    turns = chat.read_back(chat.render(chat.fold(events)))
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return turns.select(
        F.col("conv").alias("conv_id"),
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLES["op10_licenses"] = licenses.oracle_sql()


@query
def op3_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class, named by the smallest doc_id in it, and the number of documents it is linked with."""
    joined = ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    seen = Observation()
    rows = cut(joined.select(F.col("row.doc_id").alias("doc_id"), "class", F.col("links").alias("n_links")).observe(seen, F.count(F.lit(1)).alias("rows")))
    names = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    return join_counted(rows, names, ["class"], "members", seen.get["rows"]).select("doc_id", "class_id", "n_links")


@query
def op8_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other figures, names and units."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    keyed = docs.select("doc_id", *decontaminate.text_key(F.col("text")))
    return keyed.join(found, decontaminate.KEY).select("doc_id", F.col("item").alias("item_id"), "n_windows", "share", "kind")


@query
def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codebooks.with_label_error(codebooks.compress(table(spark, sf_dir, "embeddings")))
    return coded.select(F.col("id").alias("vec_id"), codebooks.hex_code(F.col("code")).alias("code"), "error", "label_error", "codebooks_sha256")


ORACLES["op11_codebooks"] = codebooks.oracle_sql()


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
