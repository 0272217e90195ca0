"""Formats by name (D4, D7): what a format recognises, how it parses, whether the stitcher goes before it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.formats import records


class RecordFormat(Protocol):
    """What a format must offer; register own ones with :func:`register`.

    ``record`` makes a struct of the columns ``records.COLUMNS`` of a trimmed line, null if it doesn't fit.
    """

    name: str
    multiline: bool
    confidence: float

    def can_parse(self, line: Column) -> Column: ...

    def record(self, line: Column, year: int) -> Column: ...


@dataclass(frozen=True)
class BuiltIn:
    name: str
    multiline: bool
    confidence: float
    test: Callable[[Column], Column]
    build: Callable[[Column, int], Column]

    def can_parse(self, line: Column) -> Column:
        return self.test(line)

    def record(self, line: Column, year: int) -> Column:
        return self.build(line, year)


#: In the order of detection; plain takes what no other does.
FORMATS: dict[str, RecordFormat] = {
    f.name: f
    for f in (
        BuiltIn("json", True, 0.95, records.is_json, lambda t, year: records.json_record(t)),
        BuiltIn("apache", False, 0.90, records.is_apache, lambda t, year: records.apache_record(t)),
        BuiltIn("nginx", False, 0.90, records.is_nginx, lambda t, year: records.nginx_record(t)),
        BuiltIn("syslog", False, 0.85, records.is_syslog, records.syslog_record),
        BuiltIn("plain", True, 0.50, lambda line: line.isNotNull(), lambda t, year: records.plain_record(t)),
    )
}


def register(fmt: RecordFormat) -> None:
    """Add a format; it is tried before plain."""
    plain = FORMATS.pop("plain")
    FORMATS[fmt.name] = fmt
    FORMATS["plain"] = plain


def parse(df: DataFrame, name: str, year: int) -> DataFrame:
    """Records of lines of one format."""
    return records.parse_with(df, lambda t: FORMATS[name].record(t, year), key=(FORMATS[name], year))


def parse_by_format(df: DataFrame, names: list[str], year: int, columns: tuple[str, ...] = records.COLUMNS) -> DataFrame:
    """Records of lines whose column ``format`` is one of the names, in one pass."""

    def build(t: Column) -> Column:
        out = F.when(F.col("format") == names[0], FORMATS[names[0]].record(t, year))
        for n in names[1:]:
            out = out.when(F.col("format") == n, FORMATS[n].record(t, year))
        return out

    return records.parse_with(df, build, columns, key=(*(FORMATS[n] for n in names), year))
