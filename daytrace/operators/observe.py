"""The observation stage: pairs of records with their history become transcriptions and summaries, with times, once and resumably.

Inference is slow and fails, so its results go into a ledger: rows are dealt to chunks by a hash of their key, chunks run in waves,
and each wave is committed by itself with the outcome of every row. A row counts as finished when the ledger holds an answer for
it; any later run plans the same rows, leaves out the finished ones by an anti-join that reads only the chunks of the wave, and
asks for the rest. A lost job loses at most its open wave, and a restart gives the table that an undisturbed run gives.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from daytrace.functions.common import join_on
from daytrace.operators.infer import infer
from daytrace.operators.pairs import pair_records, pairs_within_budget
from daytrace.session import cut

Client = Callable[[], Callable[[list[str]], list[str]]]
CHUNKS = 64
WAVE = 16


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """All outcomes written so far: the planned columns, attempt, the answers, ``error`` and ``chunk``; none before the first wave."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def run_ledger(
    planned: DataFrame, ids: Sequence[str], path: str, work: Callable[[DataFrame], DataFrame], chunks: int = CHUNKS, wave: int = WAVE,
) -> DataFrame:
    """Brings the ledger at ``path`` up to date with ``planned`` and returns it.

    ``ids`` name a planned row, and ``work`` adds its answers and ``error`` (null for an answer). ``chunks`` has to stay the same
    for one ledger; a wave is ``wave`` chunks. Rows that failed before are asked again, once a call.
    """
    spark, ids = planned.sparkSession, list(ids)
    rows = cut(planned.withColumn("chunk", F.pmod(F.xxhash64(*ids), F.lit(chunks)).cast("int")))
    before = read_ledger(spark, path)
    attempt = 1 + ((before.agg(F.max("attempt")).first()[0] or 0) if before is not None else 0)
    for low in range(0, chunks, wave):
        ours = F.col("chunk").between(low, low + wave - 1)
        todo = rows.where(ours)
        ledger = read_ledger(spark, path)
        if ledger is not None:
            done = ledger.where(ours & F.col("error").isNull()).select("chunk", *ids)
            todo = join_on(todo, done, ["chunk", *ids], "left_anti")
        if todo.isEmpty():
            continue
        dealt = todo.repartition("chunk").withColumn("attempt", F.lit(attempt))
        work(dealt).write.mode("append").partitionBy("chunk").parquet(path)
    found = read_ledger(spark, path)
    return work(rows.withColumn("attempt", F.lit(0))).limit(0) if found is None else found


def outcomes(ledger: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The standing outcome of each row: its answer, or else its last failure; ``attempts`` is how often it was asked."""
    ids = list(ids)
    rest = [c for c in ledger.columns if c not in ids]
    rank = F.struct(F.col("error").isNull(), "attempt")
    last = ledger.groupBy(*ids).agg(F.max_by(F.struct(*rest), rank).alias("_o"), F.count(F.lit(1)).alias("attempts"))
    return last.select(*ids, "_o.*", "attempts")


def chunk_status(planned: DataFrame, ledger: DataFrame, ids: Sequence[str], chunks: int = CHUNKS) -> DataFrame:
    """Planned, finished and failed rows of each chunk."""
    ids = list(ids)
    home = planned.select(*ids).withColumn("chunk", F.pmod(F.xxhash64(*ids), F.lit(chunks)).cast("int"))
    state = join_on(home, outcomes(ledger, ids).select(*ids, F.col("error").isNull().alias("_ok")), ids, "left")
    return state.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("planned"), F.count_if("_ok").alias("finished"), F.count_if(~F.col("_ok")).alias("failed"))


def observation_pairs(
    records: DataFrame, keys: Sequence[str], idx: str, payload: Sequence[str], history: int, tokens: str | None = None, budget: int | None = None,
) -> DataFrame:
    """Pairs with ``first``, ``second`` and ``history`` (structs of ``payload``). With ``budget`` a pair whose ``tokens`` do not fit
    beside its history is left out, and never enters a history. A key of one record has no pair."""
    keys = list(keys)
    if budget is None:
        return pair_records(records, keys, idx, payload, history)
    chosen = cut(pairs_within_budget(records, keys, idx, tokens, history, budget))
    wanted = F.concat(F.array("first_id", "second_id"), "history_ids")
    rows = chosen.select(*keys, "pair_idx", F.posexplode(wanted).alias("_at", "_id"))
    bodies = records.select(*keys, F.col(idx).alias("_id"), F.struct(*payload).alias("_p"))
    listed = join_on(rows, bodies, [*keys, "_id"]).groupBy(*keys, "pair_idx").agg(F.sort_array(F.collect_list(F.struct("_at", "_p"))).alias("_l"))
    held = F.transform("_l", lambda e: e["_p"])
    return listed.select(*keys, "pair_idx", held[0].alias("first"), held[1].alias("second"), F.slice(held, 3, history).alias("history"))


def observe(
    records: DataFrame, keys: Sequence[str], idx: str, payload: Sequence[str], path: str, client: Client,
    transcribe: Callable[[Column, Column], Column], summarize: Callable[[Column, Column, Column], Column],
    history: int = 4, tokens: str | None = None, budget: int | None = None, ranges: Callable[[DataFrame], DataFrame] | None = None,
    name: str = "id", calls: int = 3, chunks: int = CHUNKS, wave: int = WAVE,
) -> tuple[DataFrame, DataFrame]:
    """(layer, failures) of one modality: pair → two answers → time range.

    ``records`` hold keys, a dense ``idx`` and the ``payload`` columns, ``name`` among them. ``transcribe`` makes a prompt of a
    pair's two payloads, ``summarize`` one of history and pair. A pair is in the layer when both answers came: keys, pair_idx, a and
    b (the names of its records), history_ids, transcription, summary and what ``ranges`` adds. Failures: keys, pair_idx, error,
    attempts. ``calls`` prompts go into one call. Running it again on the same ``path`` asks only for what is not answered yet.
    """
    keys = list(keys)
    ids = [*keys, "pair_idx"]
    pairs = observation_pairs(records, keys, idx, payload, history, tokens, budget)
    planned = cut(pairs.select(
        *ids, F.col("first")[name].alias("a"), F.col("second")[name].alias("b"), F.transform("history", lambda h: h[name]).alias("history_ids"),
        transcribe(F.col("first"), F.col("second")).alias("_t"), summarize(F.col("history"), F.col("first"), F.col("second")).alias("_s"),
    ))

    def work(todo: DataFrame) -> DataFrame:
        first = infer(todo, "_t", client, calls).withColumnsRenamed({"text": "transcription", "error": "_te", "stats": "transcription_stats"})
        both = infer(first, "_s", client, calls).withColumnsRenamed({"text": "summary", "error": "_se", "stats": "summary_stats"})
        return both.withColumn("error", F.coalesce("_te", "_se")).drop("_t", "_s", "_te", "_se")

    state = outcomes(run_ledger(planned, ids, path, work, chunks, wave), ids)
    state = join_on(state, planned.select(*ids), ids, "left_semi")  # a ledger may hold pairs that are no longer planned
    layer = state.where("error is null").select(*ids, "a", "b", "history_ids", "transcription", "summary")
    return (ranges(layer) if ranges else layer), state.where("error is not null").select(*ids, "error", "attempts")
