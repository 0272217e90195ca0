"""Metadata extraction X1-X7: file and line, thread, request id, function, own patterns, stack-trace frames."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the extracted parts.
_EXT = "java|py|js|ts|cs|go|rs|cpp|c|h"
FILE_LINE = rf'"([^"]+\.(?:{_EXT}))",\s*line\s*(\d+)|(\w+\.(?:{_EXT})):(\d+)'
THREAD = r"\[([^\]]+)\]|thread[_-]?(?:id)?[=:]?\s*([a-zA-Z0-9-]+)"
REQUEST_ID = r"(?:request[_-]?id|req[_-]?id|trace[_-]?id|correlation[_-]?id)[=:]?\s*([a-zA-Z0-9-]+)"
FUNCTION = r"at\s+([a-zA-Z0-9_.]+)\("


def _either(text: Column, pattern: str, *groups: int) -> Column:
    """The first of the groups that took part in the first match."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups))


def file_of(text: Column) -> Column:
    """The file name."""
    return _either(text, FILE_LINE, 1, 3)


def line_of(text: Column) -> Column:
    """The line number, as text."""
    return _either(text, FILE_LINE, 2, 4)


def thread_of(text: Column) -> Column:
    """The leftmost bracket or thread name."""
    return _either(text, THREAD, 1, 2)


def request_id_of(text: Column) -> Column:
    """X3."""
    return _either(text, REQUEST_ID, 1)


def function_of(text: Column) -> Column:
    """X4."""
    return _either(text, FUNCTION, 1)


def custom_of(text: Column, patterns: dict[str, str]) -> dict[str, Column]:
    """Group 1 of each pattern; patterns that don't compile are dropped."""
    out = {}
    for name, pattern in patterns.items():
        try:
            groups = re.compile(pattern).groups
        except re.error:
            continue
        out[name] = _either(text, pattern, 1) if groups else F.lit(None).cast("string")
    return out


def extract(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """A map of what was found; absent keys are left out."""
    parts = {
        "file": file_of(text), "line": line_of(text), "thread": thread_of(text), "request_id": request_id_of(text),
        "function": function_of(text), **custom_of(text, patterns or {}),
    }
    made = F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v)))
    return F.map_filter(made, lambda _, v: v.isNotNull())


def extract_from_stack_trace(text: Column) -> Column:
    """Of the first frame after the first line that names a file, else of the first line."""
    lines = F.split(text, "\n")
    frames = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike(FILE_LINE))
    return extract(F.coalesce(F.get(frames, F.lit(0)), F.get(lines, F.lit(0))))
