"""Statistics: parsing A6, A7; calls of the enrichment A9, A10."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _side_by_side(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(total_lines, parsed_entries, multiline_entries): one row, from the counts of either side."""
    zero = F.lit(0).cast("bigint")
    multi = F.count_if(F.contains(F.col("message"), F.lit("\n")))
    parts = lines.agg(F.count("*").alias("a"), zero.alias("b"), zero.alias("c")).unionByName(
        entries.agg(zero.alias("a"), F.count("*").alias("b"), multi.alias("c"))
    )
    return parts.agg(F.sum("a").alias("total_lines"), F.sum("b").alias("parsed_entries"), F.sum("c").alias("multiline_entries"))


def parse_counts(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(total_lines, parsed_entries, parse_errors): blank and stitched lines count as errors."""
    both = _side_by_side(lines, entries)
    return both.select("total_lines", "parsed_entries", (F.col("total_lines") - F.col("parsed_entries")).alias("parse_errors"))


def parsing_statistics(lines: DataFrame, entries: DataFrame, duration_ms: int, errors: int = 0) -> DataFrame:
    """Counters with throughput (0 for no time) and success rate (0 for no lines)."""
    seconds = duration_ms / 1000
    return _side_by_side(lines, entries).select(
        "total_lines", "parsed_entries", F.lit(errors).cast("bigint").alias("parse_errors"), "multiline_entries",
        F.lit(duration_ms).cast("bigint").alias("duration_ms"),
        (F.col("total_lines") / seconds if duration_ms else F.lit(0.0)).alias("throughput"),
        F.coalesce(F.try_divide(F.col("parsed_entries") * 100.0, F.col("total_lines")), F.lit(0.0)).alias("success_rate"),
    )


def observed(entries: DataFrame, name: str = "parsing") -> tuple[DataFrame, Observation]:
    """The entries, and counters that are filled while some other action reads them."""
    watch = Observation(name)
    multi = F.count_if(F.contains(F.col("message"), F.lit("\n")))
    return entries.observe(watch, F.count(F.lit(1)).alias("parsed_entries"), multi.alias("multiline_entries")), watch


def analysis_statistics(calls: DataFrame) -> DataFrame:
    """Counters over the calls: cached BOOLEAN, success BOOLEAN, duration_ms, attempts.

    A cache hit is a success without duration; rates and the average over successes are 0 without calls.
    """
    hit, ok = F.col("cached"), F.col("cached") | F.col("success")
    df = calls.agg(
        F.count("*").alias("total_calls"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.count_if(hit).alias("cache_hits"),
        F.count_if(~hit).alias("cache_misses"),
        F.coalesce(F.sum(F.when(~hit & F.col("success"), F.col("duration_ms"))), F.lit(0)).alias("total_ms"),
    )
    share = lambda n: F.coalesce(F.try_divide(F.col(n) * 100.0, F.col("total_calls")), F.lit(0.0))
    return df.select(
        "*", F.coalesce(F.try_divide(F.col("total_ms") * 1.0, F.col("successful")), F.lit(0.0)).alias("avg_ms"),
        share("successful").alias("success_rate"), share("cache_hits").alias("cache_hit_rate"),
    )


def retry_histogram(calls: DataFrame) -> DataFrame:
    """A10: (attempts, n) of the calls that needed more than one."""
    return calls.where("attempts > 1").groupBy("attempts").agg(F.count("*").alias("n")).orderBy("attempts")


def top_failures(calls: DataFrame, most: int = 5, width: int = 60) -> DataFrame:
    """A10: (reason, n): the most frequent reasons of failure, ties by reason, shortened for display."""
    counts = calls.where("failure_reason IS NOT NULL").groupBy("failure_reason").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "failure_reason").limit(most)
    return top.select(F.when(F.length("failure_reason") > width, F.concat(F.substring("failure_reason", 1, width), F.lit("..."))).otherwise(F.col("failure_reason")).alias("reason"), "n")
