"""Severity maps of the record formats (P2, P6, P10, P14, P17), ranks and labels (H5), suggestion classes (H6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import SEVERITIES

# Level words of JSON records (lower case).
JSON_LEVELS = {
    "error": "Error", "err": "Error", "fatal": "Error", "critical": "Error",
    "warn": "Warning", "warning": "Warning",
    "info": "Info", "information": "Info",
    "debug": "Debug", "trace": "Trace",
}
# Level words of plain records, upper case, in the order they are tried at one place.
PLAIN_LEVELS = ("ERROR", "ERR", "FATAL", "CRITICAL", "WARN", "WARNING", "INFO", "DEBUG", "TRACE")
# Levels of the web server's error log.
NGINX_LEVELS = {
    "emerg": "Error", "alert": "Error", "crit": "Error", "error": "Error",
    "warn": "Warning", "notice": "Info", "info": "Info", "debug": "Debug",
}
# Labels and icons of the terminal report.
LABELS = {
    "Error": ("Critical", "🔴"), "Warning": ("Warning", "🟡"), "Info": ("Info", "🔵"),
    "Debug": ("Debug", "⚪"), "Trace": ("Trace", "⚫"), "Unknown": ("Unknown", "❓"),
}


def _lookup(key: Column, table: dict[str, str], other: str) -> Column:
    """A table as a constant map, so that ``key`` is evaluated once."""
    made = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(made, key), F.lit(other))


def json_severity(level: Column) -> Column:
    """Null and non-words are Unknown."""
    return _lookup(F.lower(level), JSON_LEVELS, "Unknown")


def plain_severity(line: Column) -> Column:
    """By the first level word of the line, in any case."""
    word = F.upper(F.regexp_extract(line, r"(?i)\b(" + "|".join(PLAIN_LEVELS) + r")\b", 1))
    return _lookup(word, {w.upper(): s for w, s in JSON_LEVELS.items()}, "Unknown")


def http_severity(status: Column) -> Column:
    """P10: 5xx Error, 4xx Warning, else Info."""
    return F.when(status.between(500, 599), "Error").when(status.between(400, 499), "Warning").otherwise("Info")


def nginx_severity(level: Column) -> Column:
    """P14."""
    return _lookup(level, NGINX_LEVELS, "Unknown")


def syslog_severity(priority: Column) -> Column:
    """The low three bits; a priority that isn't a byte counts as 0."""
    low = F.coalesce(F.when(priority <= 255, priority), F.lit(0)).bitwiseAND(7)
    return F.when(low <= 3, "Error").when(low == 4, "Warning").when(low <= 6, "Info").otherwise("Debug")


def rank(severity: Column) -> Column:
    """Order of groups: Error 0, Warning 1, all else 2 (O1)."""
    return F.when(severity == "Error", 0).when(severity == "Warning", 1).otherwise(2)


def code(severity: Column) -> Column:
    """Severity as its INT position, so that aggregates over it stay hash aggregates."""
    out = F.when(severity == SEVERITIES[0], 0)
    for i, label in enumerate(SEVERITIES[1:], 1):
        out = out.when(severity == label, i)
    return out.otherwise(len(SEVERITIES) - 1)


def label(code_: Column) -> Column:
    """Inverse of :func:`code`."""
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), code_ + 1)


def display_label(severity: Column) -> Column:
    """H5: label of the terminal report."""
    return _lookup(severity, {k: v[0] for k, v in LABELS.items()}, "Unknown")


def priority_class(priority: Column) -> Column:
    """H6: CSS class of a suggestion; null outside 1 to 6."""
    return F.when(priority.between(1, 3), "high").when(priority.between(4, 6), "medium")
