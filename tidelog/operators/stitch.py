"""Multi-line stitching M1-M4: stack traces join the error line before them.

The state machine's state is one bit, whether a trace is open.  Lines are range-partitioned by (source, line_no), so
that a source of any size spreads over many chunks, and joined by ``tidelog.operators.joining``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.chunks import by_ranges
from tidelog.operators.joining import Places, joined_lines, last_before
from tidelog.session import cut

# Lines that go on with a trace, and words that begin one.
CONTINUATIONS = (
    r"^\s*at\s+[\w.$]+\(",
    r'^\s+File\s+"[^"]+",\s+line\s+\d+',
    r"^\s+at\s+.*\.js:\d+",
    r"^\s+at\s+.*\sin\s+.*\.cs:line\s+\d+",
    r"^(?:goroutine\s+\d+|\t)",
    r"^\s*at ",
    r"^(?:\t| {2})",
)
ERROR_START = r"(?i)(?:Exception|Error|Traceback|Panic|Fatal|Caused by:)"
_CONTINUATION = "^(?:" + "|".join(x.removeprefix("^") for x in CONTINUATIONS) + ")"
#: Bits of a line's mark.
BLANK, GOES_ON, BEGINS = 1, 2, 4


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def is_continuation(line: Column) -> Column:
    """M2."""
    return line.rlike(_CONTINUATION) & ~is_blank(line)


def is_error_start(line: Column) -> Column:
    """M3."""
    return line.rlike(ERROR_START)


def mark(line: Column) -> Column:
    """The bits of a line."""
    rest = F.when(line.rlike(_CONTINUATION), GOES_ON).otherwise(0) + F.when(is_error_start(line), BEGINS).otherwise(0)
    return F.when(is_blank(line), BLANK).otherwise(rest)


class TraceWalk(Places):
    """The state machine of traces, vectorised; the bit says whether a trace is open."""

    def __init__(self, open_before: bool):
        super().__init__(open_before)
        self.anew = self.begins = -1

    def batch(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        bits = b["mark"].to_numpy()
        place, start = self.places(b)
        anew = last_before(bits & (BLANK | GOES_ON) == 0, place, self.anew)
        begins = last_before(bits & BEGINS > 0, place, self.begins)
        none_yet = anew[:-1] < start
        in_trace = np.where(none_yet, (begins[:-1] >= start) | (self.open_before & (start == 0)), begins[:-1] >= anew[:-1])
        head = (bits & BLANK == 0) & ~((bits & GOES_ON > 0) & in_trace)
        self.anew, self.begins = anew[-1], begins[-1]
        return head, head | in_trace

    @property
    def is_open(self) -> bool:
        if self.anew < self.start:
            return bool(self.begins >= self.start or (self.open_before and self.start == 0))
        return bool(self.begins >= self.anew)


def stitch(lines: DataFrame) -> DataFrame:
    """M1: (source, line_no, line, n_lines): one row an entry, its lines joined by line breaks, numbered by the first.

    ``lines``: source, line_no, line; other columns are ignored.  Blank lines outside of traces and null lines are
    left out; lines without source or number have no place and are left out, too; repeated places all stay.  An
    entry is one text, however many lines it has.
    """
    placed = lines.where("source IS NOT NULL AND line_no IS NOT NULL AND line IS NOT NULL")
    placed = placed.select("source", F.col("line_no").cast("bigint").alias("line_no"), "line", mark(F.col("line")).alias("mark"))
    ranged = cut(by_ranges(placed, "source", "line_no", "line"))
    return joined_lines(ranged, TraceWalk)
