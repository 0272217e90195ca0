"""The same plan on a stream: files that arrive in a folder -> groups by pattern, kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.formats.registry import parse
from tidelog.functions.text import message_pattern
from tidelog.operators.grouping import wanted
from tidelog.operators.stitch import stitch


def watch_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of text files as they arrive in a folder."""
    df = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch).text(folder)
    return df.select(F.regexp_replace(F.make_valid_utf8("value"), r"\r$", "").alias("line"))


def pattern_counts(lines: DataFrame, fmt: str = "plain", year: int = 1970) -> DataFrame:
    """Running counts by pattern, line by line; write with output mode complete or update."""
    entries = parse(lines, fmt, year).where(wanted(F.col("severity")))
    return entries.groupBy(message_pattern(F.col("message")).alias("pattern"), "severity").agg(F.count("*").alias("cnt"))


def windowed_counts(lines: DataFrame, window: str = "10 minutes", late: str = "1 hour", fmt: str = "plain", year: int = 1970) -> DataFrame:
    """Counts by time window and pattern; entries later than ``late`` behind the watermark are left out."""
    entries = parse(lines, fmt, year).where(wanted(F.col("severity")) & F.col("ts").isNotNull()).withWatermark("ts", late)
    grouped = entries.groupBy(F.window("ts", window).alias("w"), message_pattern(F.col("message")).alias("pattern"))
    return grouped.agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("window_start"), "pattern", "cnt")


def stitched_batches(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Whole entries of each batch of files, which must not split a trace: ``handle`` gets (source, line_no, line, n_lines)."""
    df = spark.readStream.option("lineSep", "\n").text(folder)
    df = df.select(F.col("_metadata.file_path").alias("source"), F.make_valid_utf8("value").alias("line"))

    def whole(batch: DataFrame, n: int) -> None:
        handle(stitch(batch.withColumn("line_no", F.monotonically_increasing_id())), n)

    start = df.writeStream.foreachBatch(whole).option("checkpointLocation", checkpoint)
    return start.trigger(availableNow=True).start()
