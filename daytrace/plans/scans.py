"""Queries that write the tables as the files a recorder leaves, and read them back by byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from daytrace.plans.registry import query, table, us
from daytrace.session import scratch_path
from daytrace.sources import files as src


@query("s1_event_arrays", """SELECT event_id, epoch_us(ts) AS ts_us, event_type, props, true AS in_place FROM events""")
def event_arrays(spark, sf):
    """JSON arrays of a recorder that still runs (their closing bracket is missing), one a writing task."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # row in its task, so position in its file
    data = F.struct(F.col("event_id").cast("string").alias("app_name"), place.cast("string").alias("action"), F.array("props").alias("window_titles"))
    event = F.to_json(F.struct(us("ts").cast("string").alias("timestamp"), "event_type", data.alias("data")))
    path = scratch_path(spark, "arrays")
    lines = table(spark, sf, "events").select(F.concat(F.when(place == 0, "[").otherwise(""), event).alias("value"))
    lines.write.option("lineSep", ",\n").text(path)
    back = src.read_events(spark, f"{path}/*.txt", src.APP_DATA, split_files=True)
    return back.select(
        F.col("data.app_name").cast("bigint").alias("event_id"), F.col("timestamp").cast("bigint").alias("ts_us"), "event_type",
        F.element_at("data.window_titles", 1).alias("props"), (F.col("ord") == F.col("data.action").cast("bigint")).alias("in_place"))


@query("s4_quoted_csv", """SELECT doc_id, lang, md5(coalesce(text, '')) AS text, NULL::DOUBLE AS absent FROM documents""")
def quoted_csv(spark, sf):
    """Whole texts, line breaks and quotes included, as quoted CSV; a column that the files lack is null."""
    path = scratch_path(spark, "csv")
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    quoted = rows.write.option("header", True).option("quoteAll", True).option("escape", '"')
    quoted.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = src.read_csv(spark, f"{path}/*.csv", "doc_id bigint, lang string, text string, absent double", split_files=True)
    return back.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("text"), "absent")
