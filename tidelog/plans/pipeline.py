"""The whole investigation as one plan: lines -> detect -> stitch -> parse -> filter -> pattern -> groups -> ranked."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.formats.records import COLUMNS
from tidelog.formats.registry import FORMATS, parse_by_format
from tidelog.functions.timestamps import custom
from tidelog.operators.detect import detect_sources
from tidelog.operators.grouping import group_entries, ranked
from tidelog.operators.metadata import extract
from tidelog.operators.stitch import stitch
from tidelog.session import cut, small_side
from tidelog.sources.config import ParserConfig


def parse_lines(lines: DataFrame, fmt: str = "auto", multiline: bool = True, year: int = 1970, columns: tuple[str, ...] = COLUMNS, config: ParserConfig | None = None) -> DataFrame:
    """Entries of lines (source, line_no, line): source, entry_no, format and the columns of a record.

    Formats are detected by source, unless one is named; an unknown name counts as auto, with a warning.  Only formats
    that take several lines go through the stitcher.  ``entry_no`` is the number of an entry's first line.  Only ``columns`` of the
    records are made; ``config`` needs all of them.
    """
    if fmt != "auto" and fmt not in FORMATS:
        warnings.warn(f"unknown format {fmt!r}, known: {', '.join(FORMATS)}; formats are detected", stacklevel=2)
    if fmt in FORMATS:
        detected = None
        with_format = lines.select("source", "line_no", "line", F.lit(fmt).alias("format"))
    else:
        detected = small_side(cut(detect_sources(lines)))
        with_format = lines.join(detected, "source").select("source", "line_no", "line", "format")
    names = [fmt] if fmt in FORMATS else list(FORMATS)
    whole = [n for n in names if multiline and FORMATS[n].multiline]
    single = [n for n in names if n not in whole]
    parts = []
    if single:
        parts.append(parse_by_format(with_format.where(F.col("format").isin(single)), single, year, columns))
    if whole:
        # a source has one format, hence its lines are stitched together whatever the format is
        own = with_format.where(F.col("format").isin(whole))
        stitched = stitch(own).drop("n_lines")
        stitched = stitched.withColumn("format", F.lit(fmt)) if detected is None else stitched.join(detected, "source")
        parts.append(parse_by_format(stitched, whole, year, columns))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return configured(out.withColumnRenamed("line_no", "entry_no"), config) if config else out.withColumnRenamed("line_no", "entry_no")


def configured(entries: DataFrame, config: ParserConfig) -> DataFrame:
    """What the settings add to entries: own time formats where no time was found, metadata, own patterns."""
    if config.custom_timestamp_formats:
        formats = [(".", f) for f in config.custom_timestamp_formats]
        found = F.coalesce("ts", *(custom(F.col("message"), [f]) for f in formats))
        entries = entries.withColumn("ts", found)
    if config.extract_metadata:
        found = extract(F.col("raw"), config.custom_metadata_patterns)
        part = lambda k: F.try_element_at(found, F.lit(k))
        entries = entries.withColumns({
            "file": F.coalesce("file", part("file")), "file_line": F.coalesce("file_line", part("line").try_cast("bigint")),
            "function": F.coalesce("function", part("function")), "thread": F.coalesce("thread", part("thread")),
            "extra": F.map_concat("extra", F.map_filter(found, lambda k, _: ~k.isin("file", "line", "function", "thread") & ~F.map_contains_key(F.col("extra"), k))),
        })
    return entries


def investigate(lines: DataFrame, as_of: str, fmt: str = "auto", multiline: bool = True, level: str | None = None, limit: int = 0, year: int = 1970) -> DataFrame:
    """Ranked groups of the errors and warnings of lines; ``as_of`` stands in for times that are missing."""
    entries = parse_lines(lines, fmt, multiline, year, ("ts", "severity", "message"))
    return ranked(group_entries(entries, as_of, level), limit)
