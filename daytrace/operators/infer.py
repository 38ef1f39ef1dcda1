"""Pluggable text-inference stages.  The engine behind a stage is any picklable callable; nothing here talks
to a model.  Prompts run in Arrow batches on the executors, with errors kept per batch or per row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from daytrace.functions import text as tx
from daytrace.functions.common import let
from daytrace.operators.ordered import Ordered, ordinal_chunk

# Fixed values -----------------------------------------------------------------------------------------
SCORE_RANGE = (1, 10)
PROPOSITION_FIELDS = ["reasoning", "proposition", "confidence", "decay"]
# ------------------------------------------------------------------------------------------------------

STATS = "struct<prompt_tokens: bigint, generation_tokens: bigint, total_tokens: bigint, latency_sec: double>"


def infer(
    df: DataFrame, prompt: str, client: Callable[[], Callable[[list[str]], list[str]]], chunk: int = 3,
    error_chars: int | None = None,
) -> DataFrame:
    """Adds ``text``, ``error`` and ``stats``.  ``client`` is built once per task and answers a list of
    prompts; ``chunk`` prompts go into one call (1 = row at a time).  A failing call marks its own rows only;
    ``error_chars`` cuts its message, which is whole without it."""
    schema = T.StructType(
        [*df.schema.fields, T.StructField("text", T.StringType()), T.StructField("error", T.StringType()),
         T.StructField("stats", T._parse_datatype_string(STATS))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = client()
        for pdf in batches:
            texts, errors, stats = [], [], []
            prompts = pdf[prompt].tolist()
            for at in range(0, len(prompts), chunk):
                part = prompts[at:at + chunk]
                began = time.perf_counter()
                try:
                    got, err = list(answer(part)), None
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} answers for {len(part)} prompts")
                except Exception as exc:  # noqa: BLE001 - any engine failure marks the rows of this call
                    got, err = [None] * len(part), str(exc)[:error_chars]
                took = (time.perf_counter() - began) / len(part)
                for p, g in zip(part, got):
                    n, m = len((p or "").split()), len((g or "").split())
                    stats.append({"prompt_tokens": n, "generation_tokens": m, "total_tokens": n + m, "latency_sec": took})
                texts += got
                errors += [err] * len(part)
            yield pdf.assign(text=texts, error=errors, stats=stats)

    return df.mapInPandas(run, schema)


def generation_totals(df: DataFrame) -> DataFrame:
    """Totals of the stats column, with generation speed."""
    total = df.agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.coalesce(F.sum(f"stats.{c}"), F.lit(0)).alias(c) for c in ("prompt_tokens", "generation_tokens", "total_tokens")],
        F.coalesce(F.sum("stats.latency_sec"), F.lit(0.0)).alias("latency_sec"),
    )
    return total.withColumn("generation_tps", F.try_divide(F.col("generation_tokens"), F.col("latency_sec")))


def parse_propositions(df: DataFrame, text: str = "text") -> DataFrame:
    """Answers → ``propositions`` (validated array of structs) and ``error``.

    Every item needs all four fields and no others, texts must be strings, scores integers (or integer
    strings) from 1 to 10.  One bad item rejects its own answer only.
    """
    body = tx.model_json(text)
    items = F.from_json(F.get_json_object(body, "$.propositions"), "array<string>")

    def kind(item: Column, field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(F.try_parse_json(item), f"$.{field}", "variant"))

    def score(item: Column, field: str) -> Column:
        return F.get_json_object(item, f"$.{field}").try_cast("int")

    def good(item: Column) -> Column:
        names = F.json_object_keys(item)
        ok = (F.size(names) == 4) & (F.size(F.array_intersect(names, F.array(*[F.lit(f) for f in PROPOSITION_FIELDS]))) == 4)
        for f in ("reasoning", "proposition"):
            ok = ok & (kind(item, f) == "STRING")
        for f in ("confidence", "decay"):
            ok = ok & score(item, f).between(*SCORE_RANGE)
        return F.coalesce(ok, F.lit(False))

    rows = df.withColumn("_body", body).withColumn("_items", items)
    only = F.size(F.json_object_keys("_body")) == 1
    fine = F.coalesce(F.col("_items").isNotNull() & only & F.forall("_items", good), F.lit(False))
    parsed = F.transform(
        "_items",
        lambda i: F.struct(
            F.get_json_object(i, "$.reasoning").alias("reasoning"),
            F.get_json_object(i, "$.proposition").alias("proposition"),
            score(i, "confidence").alias("confidence"), score(i, "decay").alias("decay"),
        ),
    )
    before = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    reason = F.when(F.col("_body").isNull(), "no valid JSON in answer").when(~fine, "answer does not match the schema")
    return (
        rows.withColumn("error", F.coalesce(before, reason))
        .withColumn("propositions", F.when(F.col("error").isNull(), parsed))
        .drop("_body", "_items")
    )


def flatten_propositions(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per proposition; failed answers have none and vanish."""
    return df.select(*keep, F.posexplode("propositions").alias("pos", "_p")).select(*keep, "pos", "_p.*")


def support_prompts(claims: DataFrame, keys: Sequence[str], batch: int, profile: str, order: str = "ord") -> DataFrame:
    """Claims of a key in batches of ``batch`` with the profile text: one checking prompt per batch."""
    keys = list(keys)
    placed = Ordered(claims, keys, [order], ordinal_chunk(order)).ordinal("_n").done()
    listed = placed.groupBy(*keys, F.expr(f"_n div {int(batch)}").alias("batch_id")).agg(
        F.sort_array(F.collect_list(F.struct(order, "text"))).alias("_c"), F.first(profile).alias("_profile")
    )
    lines = F.array_join(F.transform("_c", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["text"])), "\n")
    return listed.select(*keys, "batch_id", F.concat(F.lit("Profile:\n"), "_profile", F.lit("\n\nStatements:\n"), lines).alias("prompt"))


def support_labels(answers: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``{"results": [{proposition, supported}]}`` answers → rows; a broken answer is repaired once."""
    shape = "struct<results: array<struct<proposition: string, supported: boolean>>>"
    usable = F.when(tx.is_json(F.col(text)), F.col(text)).otherwise(tx.repair_json(text))
    return answers.select(*keep, F.explode(F.from_json(usable, shape)["results"]).alias("_r")).select(*keep, "_r.*")


# Offline stand-ins for encoders and scorers ------------------------------------------------------------

def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Deterministic bag-of-words vector: token hashes are taken in the JVM, counted per batch in NumPy."""

    @F.pandas_udf("array<float>")
    def count(slots: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in slots:
            yield pd.Series([np.bincount(v, minlength=dim).astype(np.float32) for v in s], dtype=object)

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return count(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")))


def lexical_score(a: Column, b: Column) -> Column:
    """Token Jaccard of two texts, the default pair scorer."""
    return let(tx.tokenize(a), lambda x: let(tx.tokenize(b), lambda y: words_score(x, y)))


def words_score(x: Column, y: Column) -> Column:
    """Jaccard of two arrays without repeats; 0 where both are empty."""
    common = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(common, F.size(x) + F.size(y) - common), F.lit(0.0))


def lexical_size(a: Column) -> Column:
    """Number of tokens: no ``lexical_score`` exceeds the smaller number of two texts over the larger."""
    return F.size(tx.tokenize(a))


# Sketches of ``lexical_score``: a bit for each of so many common words, and for the other words a bit for each bucket they fall into
COMMON_WORDS, TRACKED_WORDS, WORD_BUCKETS = 512, 50_000, 1_024


def lexical_words(a: Column) -> Column:
    """Hashes of the tokens of a text."""
    return F.transform(tx.tokenize(a), lambda w: F.xxhash64(w))


def common_words(texts: DataFrame, words: str = "words") -> np.ndarray:
    """Hashes of the most common words, near enough: which ones they are changes how much a sketch tells, never what is found."""
    found = texts.select(F.explode(words).alias("w")).agg(F.expr(f"approx_top_k(w, {COMMON_WORDS}, {TRACKED_WORDS})").alias("k")).first()["k"]
    return np.sort(np.array([k["item"] for k in found or []] or [0], np.int64))


def lexical_sketch(words: Column, common: np.ndarray) -> Column:
    """Bits of the words of a text, for ``lexical_bounds``."""

    @F.pandas_udf("binary")
    def sketch(rows: pd.Series) -> pd.Series:
        def one(words) -> bytes:
            words = np.asarray(words, np.int64)
            at = np.minimum(np.searchsorted(common, words), len(common) - 1)
            known = common[at] == words
            bits = np.zeros(COMMON_WORDS + WORD_BUCKETS, np.uint8)
            bits[at[known]] = 1
            bits[COMMON_WORDS + words[~known] % WORD_BUCKETS] = 1
            return np.packbits(bits).tobytes()

        return rows.map(one)

    return sketch(words)


def lexical_bounds(sizes: np.ndarray, bits: np.ndarray, others: np.ndarray, other_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible ``lexical_score`` of pairs of texts, given their ``lexical_size`` and sketch (rows of uint64).

    Common words in both are shared for sure. Each other shared word falls into a bucket set in both, and a text has at most as many
    words in those as it has beyond one in each of its buckets more than there are such buckets.
    """
    split = COMMON_WORDS // 64
    count = lambda b: (np.bitwise_count(b[:, :split]).sum(1, dtype=np.int64), np.bitwise_count(b[:, split:]).sum(1, dtype=np.int64))
    (sure, met), (common, set_), (other_common, other_set) = count(bits & other_bits), count(bits), count(other_bits)
    left, other_left = sizes - common, others - other_common
    most = sure + np.minimum(np.minimum(left, met + left - set_), np.minimum(other_left, met + other_left - other_set))

    def score(shared: np.ndarray) -> np.ndarray:
        return np.divide(shared, sizes + others - shared, out=np.zeros(len(shared)), where=sizes + others > shared)

    return score(sure), score(most)
