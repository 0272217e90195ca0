"""Delimited rows that can't be loaded, apart with the reason, while the good ones become typed fields (problem 6).

Method: rows are assembled quote-aware from their physical lines and read by Python's strict csv reader inside the
partitions; structural exceptions are captured before the typed field constructors see a row.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.chunks import by_ranges
from tidelog.operators.joining import Places, joined_lines, last_before
from tidelog.schema import SEVERITIES
from tidelog.session import cut, small_side

FIELDS = ("ts", "severity", "component", "file", "line", "thread", "duration_ms", "message")
#: What a file without known delimiter is read with.
DEFAULT_DELIMITER = ","
MOST_LINE = 4_294_967_295
#: Durations have 9 decimals; those from the bound on, after rounding, are beyond the column's range.
_DECIMALS, _BEYOND, _EXACT = Decimal("1e-9"), Decimal("1e29"), Context(prec=60)

_SEVERITY = {s.lower(): s for s in SEVERITIES}
_RFC3339 = re.compile(
    r"([0-9]{4})-([0-9]{2})-([0-9]{2})[Tt ]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?(?:([Zz])|([+-])([0-9]{2}):([0-9]{2}))"
)
_WHOLE, _DECIMAL = re.compile("[0-9]+"), re.compile(r"[0-9]+(?:\.[0-9]+)?")
#: Bits of a physical line's mark: a good row by itself, or an odd number of quotes.
GOOD, ODD = 1, 2

LOADED = (
    "row_id BIGINT, file_id BIGINT, row_no BIGINT, reason STRING, ts TIMESTAMP, severity STRING, component STRING, "
    "file STRING, line BIGINT, thread STRING, duration_ms DECIMAL(38,9), message STRING"
)
_LOADED_ARROW = pa.schema(
    [
        *((c, pa.int64()) for c in ("row_id", "file_id", "row_no")),
        ("reason", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("severity", pa.string()), ("component", pa.string()),
        ("file", pa.string()), ("line", pa.int64()), ("thread", pa.string()), ("duration_ms", pa.decimal128(38, 9)),
        ("message", pa.string()),
    ]
)


class Unloadable(ValueError):
    """Why a row is bad: quoting, column_count or invalid_value."""


def instant(text: str) -> datetime:
    """An existing RFC 3339 time with zone, T or space between; finer digits than microseconds are cut off."""
    m = _RFC3339.fullmatch(text)
    if not m:
        raise Unloadable("invalid_value")
    y, mo, d, h, mi, s = map(int, m.groups()[:6])
    if m[8] is None and (int(m[10]) > 23 or int(m[11]) > 59):
        raise Unloadable("invalid_value")
    try:
        wall = datetime(y, mo, d, h, mi, s, int((m[7] or "0")[:6].ljust(6, "0")), timezone.utc)
        offset = timedelta() if m[8] else timedelta(hours=int(m[10]), minutes=int(m[11])) * (-1 if m[9] == "-" else 1)
        return wall - offset
    except (ValueError, OverflowError):
        raise Unloadable("invalid_value") from None


def _or_none(text: str, rx: re.Pattern, kind: Callable):
    if not text:
        return None
    if not rx.fullmatch(text):
        raise Unloadable("invalid_value")
    return kind(text)


def _number(text: str) -> int:
    """A line number of digits; Python turns no text of thousands of digits into an integer."""
    digits = text.lstrip("0")
    if len(digits) > len(str(MOST_LINE)) or int(digits or "0") > MOST_LINE:
        raise Unloadable("invalid_value")
    return int(digits or "0")


def _duration(text: str) -> Decimal | None:
    """A duration with 9 decimals; null if it is beyond the column's range, yet a plain decimal number."""
    took = Decimal(text)
    took = took.quantize(_DECIMALS, context=_EXACT) if took < _BEYOND else took
    return took if took < _BEYOND else None


def typed(fields: list[str]) -> tuple:
    """The eight texts as typed values; raises Unloadable."""
    ts, severity, component, file, line, thread, duration, message = fields
    at, label, number = instant(ts), _SEVERITY.get(severity.lower()), _or_none(line, _WHOLE, _number)
    took = _or_none(duration, _DECIMAL, _duration)
    if label is None or not component:
        raise Unloadable("invalid_value")
    return at, label, component, file or None, number, thread or None, took, message


def _unquoted_quote(delimiter: str) -> re.Pattern:
    """Rows all of whose fields are either quoted as a whole or free of quotes."""
    d = re.escape(delimiter)
    field = rf'(?:"(?:[^"]|"")*+"|[^"{d}]*+)'
    return re.compile(rf"{field}(?:{d}{field})*+")


def _stand_ins(raw: str) -> tuple[dict, dict]:
    """Tables to and from two characters that the row doesn't hold, in place of its line breaks."""
    free = (c for c in map(chr, range(0xE000, 0x110000)) if c not in raw)
    hidden = {"\n": next(free), "\r": next(free)}
    return str.maketrans(hidden), str.maketrans({v: k for k, v in hidden.items()})


def split_row(raw: str, delimiter: str, shape: re.Pattern) -> list[str]:
    """The fields of one row by the strict reader; raises Unloadable for broken quoting.

    The physical lines of a row are one record: line breaks are part of its fields, quoted or not.  The reader ends a record
    at an unquoted one, so they go in as characters that the row doesn't hold.
    """
    breaks = "\n" in raw or "\r" in raw
    hide, show = _stand_ins(raw) if breaks else (None, None)
    try:
        rows = list(csv.reader((raw.translate(hide) if breaks else raw,), delimiter=delimiter, strict=True))
    except csv.Error:
        raise Unloadable("quoting") from None
    # the reader lets quotes inside unquoted fields pass
    if '"' in raw and not shape.fullmatch(raw):
        raise Unloadable("quoting")
    fields = rows[0] if rows and rows[0] else [raw]
    return [x.translate(show) for x in fields] if breaks else fields


def load_row(raw: str | None, delimiter: str, shape: re.Pattern) -> tuple:
    """(reason, typed values...): reason is None for a good row, the values are None for a bad one."""
    try:
        fields = split_row(raw or "", delimiter, shape)
        if len(fields) != len(FIELDS):
            raise Unloadable("column_count")
        return (None, *typed(fields))
    except Unloadable as bad:
        return (str(bad), *(None,) * len(FIELDS))


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(min(sys.maxsize, 2**31 - 1))
    shapes: dict[str, re.Pattern] = {}
    for b in batches:
        out = []
        for raw, delimiter in zip(b["raw"].to_pylist(), b["delimiter"].to_pylist()):
            shape = shapes.get(delimiter) or shapes.setdefault(delimiter, _unquoted_quote(delimiter))
            out.append(load_row(raw, delimiter, shape))
        columns = list(zip(*out)) if out else [()] * (len(FIELDS) + 1)
        arrays = [b[c] for c in ("row_id", "file_id", "row_no")]
        arrays += [pa.array(c, f.type) for c, f in zip(columns, list(_LOADED_ARROW)[3:])]
        yield pa.RecordBatch.from_arrays(arrays, schema=_LOADED_ARROW)


class QuoteWalk(Places):
    """Whether a quote is open, vectorised; a line that is a good row by itself ends one that was never closed."""

    def __init__(self, open_before: bool):
        super().__init__(open_before)
        self.bit = int(open_before)

    def batch(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        mark = b["mark"].to_numpy()
        place, start = self.places(b)
        good = mark & GOOD > 0
        odd = (mark & ODD > 0) & ~good
        run = np.cumsum(np.concatenate(([0], odd)))
        reset = last_before(good | ((place == start) & (place > 0)), np.arange(len(place)), -1)[1:]
        open_ = np.where(reset < 0, run[:-1] + self.bit, run[:-1] - run[np.maximum(reset, 0)]) % 2 == 1
        self.bit = int(open_[-1] ^ odd[-1])
        return good | ~open_, np.ones(len(place), bool)

    @property
    def is_open(self) -> bool:
        return bool(self.bit)


_MARKED = pa.schema([("source", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("mark", pa.int32())])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(min(sys.maxsize, 2**31 - 1))
    shapes: dict[str, re.Pattern] = {}
    for b in batches:
        marks = []
        for line, d in zip(b["line"].to_pylist(), b["delimiter"].to_pylist()):
            shape = shapes.get(d) or shapes.setdefault(d, _unquoted_quote(d))
            good = load_row(line, d, shape)[0] is None
            marks.append(GOOD if good else ODD * (line.count('"') % 2))
        yield pa.RecordBatch.from_arrays([b["source"], b["line_no"], b["line"], pa.array(marks, pa.int32())], schema=_MARKED)


def assemble_rows(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """(file_id, row_no, raw, n_lines): whole rows of physical lines; a row goes on while a quote is open.

    ``lines``: file_id, line_no, line; ``stats`` as for :func:`load_rows`; other columns are ignored.  Whether a quote is
    open is one bit, so a file of any size spreads over chunks.  A quote that is never closed costs no good row: a line that
    can be loaded by itself always begins a row, and the broken one ends before it.  ``row_no`` is the number of a row's
    first line.  Lines without file or number have no place and are left out; null lines count as empty.
    """
    placed = lines.where("file_id IS NOT NULL AND line_no IS NOT NULL")
    placed = _with_delimiter(placed.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("line_no").cast("bigint").alias("line_no"), F.coalesce("line", F.lit("")).alias("line")), stats)
    marked = cut(placed.withColumn("source", F.col("file_id").cast("string")).mapInArrow(_mark, "source STRING, line_no BIGINT, line STRING, mark INT"))
    rows = joined_lines(cut(by_ranges(marked, "source", "line_no", "line")), QuoteWalk)
    return rows.select(F.col("source").cast("bigint").alias("file_id"), F.col("line_no").alias("row_no"), F.col("line").alias("raw"), "n_lines")


def load_lines(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """The rows of files of physical lines, assembled and loaded: the columns of ``LOADED``, without ``row_id``."""
    return load_rows(assemble_rows(lines, stats).withColumn("row_id", F.lit(None).cast("bigint")), stats).drop("row_id")


def _with_delimiter(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows with the delimiter of their file."""
    known = rows.join(small_side(delimiters(stats)), "file_id", "left")
    return known.withColumn("delimiter", F.coalesce("delimiter", F.lit(DEFAULT_DELIMITER)))


def delimiters(stats: DataFrame) -> DataFrame:
    """(file_id, delimiter) of the files of rows, once each: the least one-character delimiter that stands there."""
    ok = (F.col("kind") == "rows") & (F.length("delimiter") == 1) & ~F.col("delimiter").isin('"', "\n", "\r")
    return stats.where(ok).groupBy("file_id").agg(F.min("delimiter").alias("delimiter"))


def load_rows(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Every row with ``reason`` (null if good) and, if good, its typed fields: the columns of ``LOADED``.

    ``rows``: row_id, file_id, row_no, raw; ``stats``: file_id, kind, delimiter; other columns are ignored.
    Reasons, the first that applies: 'quoting', 'column_count', 'invalid_value'.  A null, empty or blank row
    has one column.  A file without known delimiter, and a null file_id, is read with commas.  Empty texts of
    optional fields become null.  Repeated rows stay.  Durations beyond 29 digits stay good, their value null.
    """
    df = rows.select(*(F.col(c).cast("bigint") for c in ("row_id", "file_id", "row_no")), "raw")
    return _with_delimiter(df, stats).mapInArrow(_load, LOADED)


def bad_rows(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(row_id, reason) of the rows that can't be loaded."""
    return load_rows(rows, stats).where("reason IS NOT NULL").select("row_id", "reason")


def file_counts(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(file_id, n_rows, n_bad, n_quoting, n_column_count, n_invalid_value, parse_errors): counts by file.

    ``parse_errors`` is the greatest count that the statistics hold for the file, null where they hold none.
    """
    count = lambda cond: F.count_if(cond)
    counts = load_rows(rows, stats).groupBy("file_id").agg(
        F.count("*").alias("n_rows"),
        F.count("reason").alias("n_bad"),
        *(count(F.col("reason") == r).alias(f"n_{r}") for r in ("quoting", "column_count", "invalid_value")),
    )
    said = stats.where("kind = 'rows'").groupBy("file_id").agg(F.max("parse_errors").alias("parse_errors"))
    return counts.join(said, "file_id", "left")
