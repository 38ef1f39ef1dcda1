"""Scans of one large JSON array or quoted CSV file by many tasks.

Spark splits text files at a separator, whatever surrounds it, but a record of such a file can only be told from its text when it
is known whether a byte lies inside quotes. Here files are split into fragments at every ``}`` (or line end), by byte ranges as
any text scan. Each block of a file sums up what it does to the state (quotes, braces, brackets) for both states it could
begin in; the summaries, one row a block, are carried over the blocks of a file, and with them every fragment knows its true state.
Record ends follow, their running number is the position of the record, and fragments of one record meet in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BLOCK = ["_file", "_block"]


def fragments(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """Pieces of text files between separators: value, ``_file``, ``_block`` (first byte of the block), ``_row`` (order in a block)."""
    return spark.read.option("lineSep", separator).text(paths).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _in_block(last: int = 0) -> Window:
    return Window.partitionBy(*BLOCK).orderBy("_row").rowsBetween(Window.unboundedPreceding, last)


def _before_in_block(value: Column) -> Column:
    return F.coalesce(F.sum(value).over(_in_block(-1)), F.lit(0))


def _over_blocks(value: Column) -> Column:
    """Sum over the earlier blocks of the file; for one row a block."""
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what)))


def _numbered(ends: DataFrame, separator: str) -> DataFrame:
    """Fragments with ``_end`` → one row a record: ``_file``, ``ord`` (from 0), ``record`` (its fragments joined) and
    ``complete`` (whether its end was found; only the last of a file can lack it)."""
    marked = ends.withColumn("_ended", F.col("_end").cast("int"))
    local = marked.withColumn("_before", _before_in_block(F.col("_ended")))
    offsets = marked.groupBy(*BLOCK).agg(F.sum("_ended").alias("_n")).select(*BLOCK, _over_blocks(F.col("_n")).alias("_offset"))
    keyed = local.join(offsets, BLOCK).withColumn("ord", F.col("_before") + F.col("_offset"))
    parts = keyed.groupBy("_file", "ord").agg(
        F.sort_array(F.collect_list(F.struct("_block", "_row", "value"))).alias("_parts"), F.max("_end").alias("complete"))
    return parts.select("_file", "ord", F.array_join(F.transform("_parts", lambda p: p["value"]), separator).alias("record"), "complete")


def json_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The objects of JSON-array files (or a file's only object) as text: ``_file``, ``ord``, ``record``.

    Files are valid JSON whose array holds objects. An unfinished last object comes as it is, so that parsing makes its fields
    null; an empty file or array has no row.
    """
    cut_at = fragments(spark, paths, "}")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escape pairs, so that every quote opens or closes a string
    local = cut_at.withColumn("_bare", bare).withColumn("_quotes", _count(F.col("_bare"), '"'))
    local = local.withColumn("_odd", F.pmod(_before_in_block(F.col("_quotes")), F.lit(2)))

    def effect(start: int) -> Column:
        """Braces opened less closed, if the block begins inside a string (1) or not (0)."""
        inside = F.pmod(F.col("_odd") + start, F.lit(2))
        outside = F.regexp_replace(F.concat(F.when(inside == 1, '"').otherwise(""), "_bare"), r'"[^"]*"?', "")
        closes = F.pmod(inside + F.col("_quotes"), F.lit(2)) == 0
        return F.struct(_count(outside, "{").alias("opens"), closes.alias("closes"))

    local = local.select("value", *BLOCK, "_row", "_quotes", effect(0).alias("_e0"), effect(1).alias("_e1"))
    change = lambda e: F.col(f"{e}.opens") - F.col(f"{e}.closes").cast("int")
    sums = local.groupBy(*BLOCK).agg(F.sum("_quotes").alias("q"), F.sum(change("_e0")).alias("d0"), F.sum(change("_e1")).alias("d1"))
    starts = sums.withColumn("_start", F.pmod(_over_blocks(F.col("q")), F.lit(2)))
    starts = starts.select(*BLOCK, "_start", _over_blocks(F.when(F.col("_start") == 1, F.col("d1")).otherwise(F.col("d0"))).alias("_depth"))
    known = local.join(starts, BLOCK).withColumn("_e", F.when(F.col("_start") == 1, F.col("_e1")).otherwise(F.col("_e0")))
    before = F.col("_depth") + _before_in_block(change("_e"))
    ends = known.withColumn("_inner", before + F.col("_e.opens")).select(
        "value", *BLOCK, "_row", (F.col("_e.closes") & (F.col("_inner") == 1)).alias("_end"))
    trimmed = F.regexp_replace("record", r"^[\s\x{FEFF}]*[\[,]?\s*", "")
    found = _numbered(ends, "}").withColumn("record", F.when(F.col("complete"), F.concat(trimmed, F.lit("}"))).otherwise(trimmed))
    return found.where(F.startswith("record", F.lit("{"))).select("_file", "ord", "record")


def csv_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of CSV files whose quoted fields may hold line breaks and doubled quotes: ``_file``, ``ord`` (the header has 0),
    ``record``. Blank lines between records are no records."""
    local = fragments(spark, paths, "\n").withColumn("_quotes", _count(F.col("value"), '"'))
    starts = local.groupBy(*BLOCK).agg(F.sum("_quotes").alias("q")).select(*BLOCK, _over_blocks(F.col("q")).alias("_offset"))
    known = local.withColumn("_so_far", F.sum("_quotes").over(_in_block())).join(starts, BLOCK)
    total, before = F.col("_so_far") + F.col("_offset"), F.col("_so_far") - F.col("_quotes") + F.col("_offset")
    blank = (F.pmod(before, F.lit(2)) == 0) & (F.rtrim(F.regexp_replace("value", r"\r$", "")) == "")
    ends = known.where(~blank).select("value", *BLOCK, "_row", (F.pmod(total, F.lit(2)) == 0).alias("_end"))
    return _numbered(ends, "\n").select("_file", "ord", F.regexp_replace("record", r"\r$", "").alias("record"))
