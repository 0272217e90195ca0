"""Grouping of errors and warnings by pattern: A1-A5, O1, L1, L2, W1, F1, F3.

Counts are pre-aggregated on the map side; severities and places travel as integers so that the aggregate stays a
hash aggregate.  No group's entries are ever collected, not even for reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import severity as sev
from tidelog.functions.text import group_id, message_pattern
from tidelog.operators.chunks import number_within
from tidelog.session import cut

#: Severities that are grouped (F1), and what the severity option widens or narrows them to.
GROUPED = ("Error", "Warning")
LEVELS = {"error": ("Error",), "warn": ("Warning",), "info": ("Info",)}


def wanted(severity: Column, level: str | None = None) -> Column:
    """F1, or F3 with a level."""
    return severity.isin(*(LEVELS[level] if level else GROUPED))


def with_pattern(entries: DataFrame, level: str | None = None) -> DataFrame:
    """Entries of the wanted severities with their pattern and group id; the pattern is made after the filter."""
    df = entries.where(wanted(F.col("severity"), level))
    return df.withColumn("pattern", message_pattern(F.col("message"))).withColumn("group_id", group_id(F.col("pattern")))


def group_entries(entries: DataFrame, as_of: str, level: str | None = None) -> DataFrame:
    """A1, A2: one row a pattern, ordered by nothing: group_id, pattern, cnt, first_seen, last_seen, severity, example.

    ``entries``: entry_no (order of arrival), ts, severity, message and, for examples, file and file_line.  Where they
    have a column ``source``, ``entry_no`` counts within it and sources follow each other by name; the result then has
    ``first_source``, too.  The severity is that of the first entry.  A first entry without time counts as ``as_of``;
    later entries without time leave the bounds as they are.
    """
    within = _order(entries)[:-1]
    df = entries.where(wanted(F.col("severity"), level)).select(
        message_pattern(F.col("message")).alias("pattern"), *within, "entry_no", F.unix_micros("ts").alias("us"), sev.code(F.col("severity")).alias("code"),
    )
    start = F.coalesce("us", F.unix_micros(F.lit(as_of).cast("timestamp")))
    grouped = df.groupBy("pattern", *within).agg(
        F.count("*").alias("cnt"),
        F.min("us").alias("low"),
        F.max("us").alias("high"),
        F.min("entry_no").alias("first_no"),
        F.min_by("code", "entry_no").alias("code"),
        F.min_by(start, "entry_no").alias("start"),
    )
    if within:
        first = F.min_by(F.struct("first_no", "code", "start", F.col("source").alias("first_source")), F.coalesce("source", F.lit(""))).alias("first")
        grouped = grouped.groupBy("pattern").agg(F.sum("cnt").alias("cnt"), F.min("low").alias("low"), F.max("high").alias("high"), first)
        grouped = grouped.select("pattern", "cnt", "low", "high", "first.*")
    return grouped.select(
        group_id(F.col("pattern")).alias("group_id"),
        "pattern",
        "cnt",
        F.timestamp_micros(F.least("start", "low")).alias("first_seen"),
        F.timestamp_micros(F.greatest("start", "high")).alias("last_seen"),
        sev.label(F.col("code")).alias("severity"),
        "first_no",
        *(f"first_{c}" for c in within),
    )


def _order(entries: DataFrame) -> list[str]:
    """The columns that order entries: by source, where they have one, then by number."""
    return [c for c in ("source", "entry_no") if c in entries.columns]


def ranked(groups: DataFrame, limit: int = 0) -> DataFrame:
    """O1, L1: errors first, then by count, ties by pattern; a limit of 0 is none."""
    df = groups.orderBy(sev.rank(F.col("severity")), F.desc("cnt"), "pattern")
    return df.limit(limit) if limit else df


def with_examples(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """A2: the message, file and line of each group's first entry, joined by its place, which must be unique."""
    place = {"entry_no": "first_no", "source": "first_source"}
    first = entries.select(*(F.col(c).alias(place[c]) for c in _order(entries)), F.col("message").alias("example_message"), F.col("file").alias("example_file"), F.col("file_line").alias("example_line"))
    if "source" not in entries.columns:
        return groups.join(first, "first_no", "left")
    at = (groups["first_no"] == first["first_no"]) & groups["first_source"].eqNullSafe(first["first_source"])
    return groups.join(first, at, "left").drop(first["first_no"]).drop(first["first_source"])


def occurrences(entries: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every grouped entry with its number within its group.

    ``keep`` names the columns to carry along, all by default; the rows are written twice, so few are cheaper.
    """
    order = tuple(_order(entries))
    df = with_pattern(entries)
    if keep is not None:
        df = df.select("group_id", *dict.fromkeys((*order, *keep)))
    return number_within(cut(df), "group_id", order, "occurrence")


def top_examples(entries: DataFrame, most: int = 3) -> DataFrame:
    """L2: (group_id, examples): the first messages of each group.

    The rank filter is applied before the shuffle as well (window group limit), so a large group sends few rows.
    """
    order = Window.partitionBy("group_id").orderBy(*_order(entries))
    first = with_pattern(entries).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    parts = F.array_sort(F.collect_list(F.struct("n", "message")))
    return first.groupBy("group_id").agg(F.transform(parts, lambda x: x["message"]).alias("examples"))


def totals(groups: DataFrame) -> DataFrame:
    """A4: number of groups and of their entries."""
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_entries"))


def time_range(entries: DataFrame, level: str | None = None) -> DataFrame:
    """A5: (range_start, range_end): least time of the groups' first entries, greatest of their last.

    A group whose first entry has no time hides the start, as one whose last has none doesn't count for the end.
    """
    within, us = _order(entries)[:-1], F.coalesce(F.unix_micros("ts"), F.lit(-(2**62)))
    per = with_pattern(entries, level).groupBy("group_id", *within).agg(F.min_by(us, "entry_no").alias("a"), F.max_by(us, "entry_no").alias("b"))
    if within:
        source = F.coalesce("source", F.lit(""))
        per = per.groupBy("group_id").agg(F.min_by("a", source).alias("a"), F.max_by("b", source).alias("b"))
    known = lambda c: F.when(c > -(2**62), F.timestamp_micros(c))
    return per.agg(F.min("a").alias("a"), F.max("b").alias("b")).select(known(F.col("a")).alias("range_start"), known(F.col("b")).alias("range_end"))


def entries_of(groups: DataFrame, entries: DataFrame, level: str | None = None) -> DataFrame:
    """(group_id, occurrence, ts, severity, message, file, file_line, raw): all entries of the groups, in their order.

    One row an entry, never a list a group, as one group may hold a third of all entries.
    """
    columns = ("ts", "severity", "message", "file", "file_line", "raw")
    kept = with_pattern(entries, level).join(groups.select("group_id"), "group_id", "left_semi")
    order = tuple(_order(entries))
    numbered = number_within(cut(kept.select("group_id", *order, *columns)), "group_id", order, "occurrence")
    return numbered.select("group_id", "occurrence", *columns)
