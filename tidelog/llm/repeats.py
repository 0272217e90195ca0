"""Repeated consecutive events of a log file as one event with count and duration (problem 3).

Method: associative run summaries.  Range-sorted chunks encode their runs locally; a prefix merge joins
compatible first and last runs across chunk boundaries (``tidelog.operators.chunks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.text import message_pattern
from tidelog.operators.chunks import by_ranges, runs_in_order
from tidelog.operators.instants import resolve_instants
from tidelog.session import cut


def event_letters(message: Column) -> Column:
    """What makes two messages the same event: the letters a-z of the lower-cased pattern."""
    return F.regexp_replace(F.lower(message_pattern(message)), "[^a-z]+", "")


def _event_key(message: Column, place: Column) -> Column:
    """A non-negative 63-bit key of the event; a null message equals nothing, not even its neighbour."""
    return F.coalesce(F.shiftrightunsigned(F.xxhash64(event_letters(message)), 1), -2 - F.abs(place))


def _runs(entries: DataFrame, instant: Column, least: int) -> DataFrame:
    narrow = entries.where("file_id IS NOT NULL AND entry_no IS NOT NULL").select(
        F.col("file_id").cast("bigint").alias("grp"),
        F.col("entry_no").cast("bigint").alias("no"),
        F.when(F.col("message").isNotNull(), _event_key(F.col("message"), F.col("entry_no")))
        .otherwise(-2 - F.abs(F.col("entry_no")))
        .alias("key"),
        instant.alias("t"),
        F.lit(None).cast("string").alias("tag"),
        F.col("entry_id").alias("id"),
    )
    # Drawing the ranges reads its input twice, hence the patterns are computed before that, once.
    return runs_in_order(by_ranges(cut(narrow), "grp", "no", "id"), least)


def repeated_events(entries: DataFrame, least: int = 3) -> DataFrame:
    """(file_id, first_no, last_no, n_events): stretches of at least ``least`` records of the same event.

    ``entries``: entry_id, file_id, entry_no, message; other columns are ignored.  Records of the same file and
    number are redeliveries, of which the one with the least entry_id counts; skipped numbers don't end a stretch.
    Records without file or number have no place and are left out; a null message is no event and ends the
    stretch; empty messages and messages without letters are the same event.
    """
    runs = _runs(entries, F.lit(None).cast("bigint"), least)
    return runs.select(F.col("grp").alias("file_id"), "first_no", "last_no", F.col("n").alias("n_events"))


def collapsed_events(entries: DataFrame, sources: DataFrame, least: int = 1) -> DataFrame:
    """(file_id, first_no, last_no, n_events, duration_us): every run of the same event with its duration.

    As :func:`repeated_events`, with the time from the earliest to the latest certain instant of the run in
    microseconds, null if it has none.
    """
    df = resolve_instants(entries, sources)
    runs = _runs(df, F.col("epoch_us"), least)
    return runs.select(
        F.col("grp").alias("file_id"), "first_no", "last_no", F.col("n").alias("n_events"), (F.col("t_max") - F.col("t_min")).alias("duration_us")
    )
