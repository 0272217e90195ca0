"""Format detection D1-D3: by the first line of a source, with a confidence, or by a vote of samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.formats.registry import FORMATS
from tidelog.session import cut, small_side


def format_of(line: Column) -> Column:
    """The first format that can parse the line, else plain."""
    names = [n for n in FORMATS if n != "plain"]
    start = F.when(FORMATS[names[0]].can_parse(line), names[0])
    return reduce(lambda c, n: c.when(FORMATS[n].can_parse(line), n), names[1:], start).otherwise("plain")


def confidence_of(fmt: Column) -> Column:
    """How sure the detection of a format is."""
    names = list(FORMATS)
    start = F.when(fmt == names[0], FORMATS[names[0]].confidence)
    return reduce(lambda c, n: c.when(fmt == n, FORMATS[n].confidence), names[1:], start)


def detect_sources(lines: DataFrame) -> DataFrame:
    """(source, format) by the line of the least number of each source.

    The least numbers come from a hash aggregate over two narrow columns; only lines that stand there are read as text.
    """
    least = small_side(cut(lines.groupBy("source").agg(F.min("line_no").alias("line_no"))))
    first = lines.select("source", "line_no", "line").join(least, ["source", "line_no"]).groupBy("source").agg(F.min("line").alias("line"))
    return first.select("source", F.coalesce(format_of(F.col("line")), F.lit("plain")).alias("format"))


def detect_from_samples(lines: DataFrame) -> DataFrame:
    """D3: (source, format) by the most matches of all lines; ties in the order of detection, none is plain."""
    names = [n for n in FORMATS if n != "plain"]
    counts = lines.groupBy("source").agg(*(F.count_if(FORMATS[n].can_parse(F.col("line"))).alias(f"_tl_{n}") for n in names))
    most = F.greatest(*(F.col(f"_tl_{n}") for n in names))
    start = F.when(most == 0, "plain")
    winner = reduce(lambda c, n: c.when(F.col(f"_tl_{n}") == most, n), names, start)
    return counts.select("source", winner.alias("format"))
