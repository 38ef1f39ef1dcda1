"""File sources.  Positions in a file act as identifiers downstream, so every scan adds an explicit ordinal;
folder names carry user, modality and model, so every listing parses them into columns."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from daytrace.functions import text as tx
from daytrace.sources import ranges

APP_DATA = (
    "struct<app_name: string, action: string, window_titles: array<string>, current_windows: array<string>, "
    "added_windows: array<string>, removed_windows: array<string>>"
)
MOUSE_DATA = "struct<x: double, y: double, action: string>"
KEYBOARD_DATA = "struct<action: string, key_char: string, modifiers: map<string, boolean>, timestamp_precise: double>"
SCREEN_DATA = "struct<frames_written: bigint, duration: double, filename: string, start_time: string>"

# Fixed values -----------------------------------------------------------------------------------------
STATEMENT_FILES = ["unique_propositions.csv", "propositions.csv", "propositions.jsonl"]
# ------------------------------------------------------------------------------------------------------


def with_file_ordinal(rows: DataFrame, name: str = "ord") -> DataFrame:
    """0-based row position inside each file of an unsplit scan (multi-line JSON, whole files).

    Rows of one file are contiguous in one partition, so the position is the running row id minus the file's
    first; that needs one small aggregate per file and no sort.
    """
    tagged = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.monotonically_increasing_id())
    first = tagged.groupBy("_file").agg(F.min("_row").alias("_first"))
    return tagged.join(first, "_file").withColumn(name, F.col("_row") - F.col("_first")).drop("_row", "_first")


def with_user(rows: DataFrame, path_column: str = "_file", depth: int = 2) -> DataFrame:
    """Adds ``user``: the folder ``depth - 1`` levels above the file."""
    return rows.withColumn("user", F.element_at(F.split(path_column, "/"), -depth))


def json_rows(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, split_files: bool) -> DataFrame:
    """Objects of JSON-array files with their ``ord`` and ``_file``; with ``split_files``, many tasks share a file."""
    if not split_files:
        return with_file_ordinal(spark.read.schema(schema).option("multiLine", True).json(paths))
    found = ranges.json_objects(spark, paths)
    return found.select("_file", "ord", F.from_json("record", schema).alias("_r")).select("_file", "ord", "_r.*")


def read_events(spark: SparkSession, paths: str | list[str], data: str, split_files: bool = False) -> DataFrame:
    """JSON-array event logs → user, ord, timestamp (text), ts, event_type, typed ``data``.  The array is
    streamed row by row, never held whole; ``split_files`` deals byte ranges of large files to many tasks."""
    schema = T.StructType([
        T.StructField("timestamp", T.StringType()), T.StructField("event_type", T.StringType()),
        T.StructField("data", T._parse_datatype_string(data)),
    ])
    return with_user(json_rows(spark, paths, schema, split_files)).select(
        "user", "ord", "timestamp", F.try_to_timestamp("timestamp").alias("ts"), "event_type", "data")


def read_snapshots(spark: SparkSession, paths: str | list[str], split_files: bool = False) -> DataFrame:
    """Accessibility files (an array, or ``{"records": [...]}``) → user, ord, raw ``accessibility`` and
    ``app_event`` JSON with key order kept.  ``split_files`` as in ``read_events``; it splits arrays only, and
    drops spaces between JSON tokens."""
    schema = "accessibility string, app_event string, records array<struct<accessibility: string, app_event: string>>"
    rows = with_user(json_rows(spark, paths, schema, split_files))
    nested = rows.where("records is not null").select("user", F.posexplode("records").alias("ord", "_r")).select(
        "user", F.col("ord").cast("bigint"), "_r.accessibility", "_r.app_event")
    return rows.where("records is null").select("user", "ord", "accessibility", "app_event").unionByName(nested)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines with their file and a sortable position ``line`` (block start, row id in the block)."""
    rows = spark.read.text(paths)
    return rows.select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line"),
    )


def parse_lines(lines: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines → columns of ``schema`` beside the line columns.  Blank lines are skipped; malformed ones are
    dropped, or fail the job when ``strict``."""
    full = T._parse_datatype_string(schema)
    with_bad = T.StructType([*full.fields, T.StructField("_bad", T.StringType())])
    body = lines.where(tx.trim_ws("value") != "")
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_json("value", full if strict else with_bad, options)
    out = body.withColumn("_j", parsed)
    if not strict:
        out = out.where(F.col("_j").isNotNull() & F.col("_j._bad").isNull() & F.is_valid_utf8("value"))
    rest = [c for c in lines.columns if c != "value"]
    return out.select(*rest, *[F.col(f"_j.{f.name}").alias(f.name) for f in full.fields])


def last_per_pair(rows: DataFrame, keys: Sequence[str], position: str = "line") -> DataFrame:
    """Keep the last row per (keys, pair_idx); rows without a pair are dropped."""
    rest = [c for c in rows.columns if c not in {*keys, "pair_idx", position}]
    return (
        rows.where("pair_idx is not null").groupBy(*keys, "pair_idx")
        .agg(F.max_by(F.struct(*rest), position).alias("_last")).select(*keys, "pair_idx", "_last.*")
    )


STATEMENT_SCHEMA = (
    "batch_id bigint, proposition string, confidence string, "
    "propositions array<struct<proposition: string, confidence: string>>"
)


def statements(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Statement records, one per line or a list per line → text, batch_id, confidence; blanks dropped."""
    one = rows.where("proposition is not null").select(*keep, "batch_id", F.lit(-1).alias("pos"), "proposition", "confidence")
    many = rows.select(*keep, "batch_id", F.posexplode("propositions").alias("pos", "_p")).select(*keep, "batch_id", "pos", "_p.*")
    both = one.unionByName(many).withColumn("text", tx.trim_ws("proposition")).drop("proposition")
    return both.where(F.col("text") != "")


def read_statements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Statement files, CSV or JSON lines by extension → file, pos, text, batch_id, confidence."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    csvs = [p for p in paths if p.endswith(".csv")]
    lines = [p for p in paths if not p.endswith(".csv")]
    parts = []
    if lines:
        rows = parse_lines(read_lines(spark, lines), STATEMENT_SCHEMA, strict=True)
        parts.append(statements(rows, ["file", "line"]))
    if csvs:
        rows = read_csv(spark, csvs, "proposition string, confidence string, decay string")
        parts.append(rows.select(
            F.col("_file").alias("file"), F.struct(F.lit(0).cast("bigint").alias("block"), F.col("ord").alias("row")).alias("line"),
            F.lit(None).cast("bigint").alias("batch_id"), F.lit(-1).alias("pos"), "confidence",
            tx.trim_ws(F.coalesce("proposition", F.lit(""))).alias("text"),
        ).where(F.col("text") != ""))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def observations(rows: DataFrame, keep: Sequence[str], layer: str) -> DataFrame:
    """Summary or transcription layer as statements; the pair number is their time."""
    return rows.select(*keep, tx.trim_ws(F.coalesce(layer, F.lit(""))).alias("text"), F.col("pair_idx").alias("batch_id")).where(F.col("text") != "")


def headers(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """CSV paths by their first line, one line a file; the driver holds the list of files anyway."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    first = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("head"))
    out: dict[str, list[str]] = {}
    for row in first.orderBy("path").collect():
        out.setdefault(row["head"].rstrip("\r"), []).append(unquote(row["path"]))
    return out


def csv_strings(spark: SparkSession, paths: list[str], head: str, split_files: bool) -> DataFrame:
    """All columns of CSV files of one header, as text, with ``ord`` and ``_file``."""
    if not split_files:
        return with_file_ordinal(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths).select("*", "_metadata"))
    names = spark.range(1).select(F.from_csv(F.lit(head), ", ".join(f"c{k} string" for k in range(head.count(",") + 1)), {"escape": '"'}).alias("h")).first()["h"]
    records = ranges.csv_records(spark, paths).where("ord > 0")
    parsed = records.select("_file", (F.col("ord") - 1).alias("ord"), F.from_csv("record", ", ".join(f"`{n}` string" for n in names if n is not None), {"escape": '"', "multiLine": "true"}).alias("_r"))
    return parsed.select("_file", "ord", "_r.*")


def read_csv(spark: SparkSession, paths: str | list[str], schema: str, split_files: bool = False) -> DataFrame:
    """CSV with a header and quoted line breaks, columns by name, with ``ord`` per file and ``_file``. Files may have different
    headers: those of one header are read together, and columns that a file lacks are null.  ``split_files`` deals byte ranges of large files to many tasks;
    column names then are unique and hold no line break."""
    wanted = T._parse_datatype_string(schema)
    out = None
    for head, same in headers(spark, paths).items() or [("", paths)]:
        rows = csv_strings(spark, same, head, split_files and bool(head))
        picked = [
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted.fields
        ]
        part = rows.select(*picked, "ord", "_file")
        out = part if out is None else out.unionByName(part)
    return out


def first_rows(rows: DataFrame) -> DataFrame:
    return rows.where("ord = 0")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below ``root``: path, folder, name, size.  The listing runs on the executors; contents are
    pruned."""
    rows = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .load(root).select("path", F.col("length").alias("size"))
    )
    parts = F.split("path", "/")
    return rows.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "size")


def parse_folders(files: DataFrame, allowed: Sequence[str] | None = None) -> DataFrame:
    """Adds user, modality and model from ``<user>/<modality>_<model>/<file>``."""
    parts = F.split("path", "/")
    out = files.withColumn("user", F.element_at(parts, -3)).withColumn("modality", F.split_part("folder", F.lit("_"), F.lit(1)))
    out = out.withColumn("model", F.when(F.contains("folder", F.lit("_")), F.regexp_replace("folder", r"^[^_]*_", "")))
    return out.where(F.col("modality").isin(list(allowed))) if allowed else out


def first_folder(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keep, per ``by``, only the first folder by name."""
    first = files.groupBy(*by).agg(F.min("folder").alias("folder"))
    return files.join(first, [*by, "folder"], "left_semi")


def preferred_files(files: DataFrame, names: Sequence[str] = STATEMENT_FILES, by: Sequence[str] = ("user", "folder")) -> DataFrame:
    """Per folder the first existing file of a preference list."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    ranked = files.withColumn("_rank", rank).where("_rank > 0")
    best = ranked.groupBy(*by).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*by, "_rank"], "left_semi").drop("_rank")


def latest_file(files: DataFrame, base: str, by: Sequence[str] = ("folder",)) -> DataFrame:
    """Per folder ``base.json``, else the last ``base_*.json`` by name."""
    exact = F.col("name") == f"{base}.json"
    stamped = F.col("name").startswith(f"{base}_") & F.col("name").endswith(".json")
    pick = F.max_by("path", F.struct(exact.cast("int"), F.col("name")))
    return files.where(exact | stamped).groupBy(*by).agg(pick.alias("path"))


def frame_files(files: DataFrame, extensions: Sequence[str] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    keep = F.lit(False)
    for e in extensions:
        keep = keep | F.lower("name").endswith(e)
    return files.where(keep)


def run_results(spark: SparkSession, roots: dict[str, str | None] | str, metrics: Sequence[str], modalities: Sequence[str] = ()) -> DataFrame:
    """Result files ``<root>/<user>/<model>/<method>__<mods>.csv``, first row each → tidy runs.

    Numbers that do not parse become null; an ``eval_count`` that is missing or 0 falls back to
    ``candidate_count``.  A root may relabel its method.  ``modalities`` names the ``count_<m>`` columns to bring along.
    """
    roots = {roots: None} if isinstance(roots, str) else roots
    counts = [f"count_{m}" for m in modalities]
    out = None
    for root, label in roots.items():
        schema = ", ".join(["status string", "modalities string", *[f"{m} double" for m in ("candidate_count", "eval_count", "ideal_count", *counts, *metrics)]])
        rows = first_rows(read_csv(spark, f"{root}/*/*/*.csv", schema))
        parts = F.split("_file", "/")
        named = rows.withColumn("_run", tx.run_name("_file"))
        tidy = named.where(F.element_at(parts, -1) != "comparison.csv").select(
            F.element_at(parts, -3).alias("user"), F.element_at(parts, -2).alias("model"),
            (F.lit(label) if label else F.col("_run.method")).alias("method"),
            F.coalesce(F.nullif("_run.modalities", F.lit("")), "modalities", F.lit("")).alias("modalities"),
            F.coalesce("status", F.lit("")).alias("status"), "candidate_count",
            F.coalesce(F.nullif("eval_count", F.lit(0.0)), "candidate_count").alias("eval_count"), "ideal_count", *counts, *metrics,
        )
        out = tidy if out is None else out.unionByName(tidy)
    return out


def user_pool(rows: DataFrame, user: str, text: str = "text", order: str = "ord") -> DataFrame:
    """Distinct texts of a user with the first position each was seen at."""
    return rows.groupBy(user, text).agg(F.min(order).alias("first_ord"))


def discover_models(folders: DataFrame, exclude: str = "gpt") -> DataFrame:
    """Distinct (user, model) of a folder listing without the reference model."""
    return folders.where(F.col("model").isNotNull() & ~F.contains("model", F.lit(exclude))).select("user", "model").distinct()


def merged_runs(folders: DataFrame, prefix: str) -> DataFrame:
    """Folders ``<prefix>+<mods>_<model>`` that hold statements → mods tag and model."""
    found = folders.where(F.col("folder").startswith(f"{prefix}+") & F.col("name").isin(STATEMENT_FILES))
    return found.select(
        "user", "folder", F.substring_index("folder", "_", 1).alias("mods"), F.regexp_replace("folder", r"^[^_]*_", "").alias("model")
    ).distinct()


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole text files: path and text."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_claims(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One claim per non-blank line."""
    return read_lines(spark, paths).select("file", "line", tx.trim_ws("value").alias("text")).where(F.col("text") != "")
