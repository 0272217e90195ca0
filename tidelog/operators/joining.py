"""Texts of several lines joined into one row, without a task that holds a whole source.

Lines stand in sorted ranges.  Which line begins a row depends on one bit of state, hence a chunk is a function of the
bit that enters it.  A first pass describes each chunk for both values of the bit; composing these descriptions, one a
chunk, gives the bit that enters each chunk and the chunk whose last row a chunk's first lines go on with.  A second
pass makes the rows of each chunk; only what crosses the edges of chunks is joined to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import cut, small_side

_LAST = 1  # ``edge`` of a chunk's last row


class Walk(Protocol):
    """Goes over the sorted batches (source, line_no, line, mark) of one chunk, for a given bit at its beginning."""

    first: str | None
    source: str | None

    def batch(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(head, kept) of the rows: whether a line begins a row, whether it stands in one at all."""

    @property
    def is_open(self) -> bool:
        """The bit after the last row."""


class Places:
    """What all walks keep: the running place, and where the present source began."""

    def __init__(self, open_before: bool):
        self.open_before, self.at, self.start = open_before, 0, -1
        self.source: str | None = None
        self.first: str | None = None

    def places(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(place, start): the running number of each row, and that of the first row of its source in the chunk."""
        n = b.num_rows
        place = np.arange(self.at, self.at + n)
        source = b["source"].dictionary_encode().indices.to_numpy()
        fresh = np.ones(n, bool)
        fresh[1:] = source[1:] != source[:-1]
        name = b["source"][0].as_py()
        fresh[0] = self.at == 0 or name != self.source
        if self.at == 0:
            self.first = name
        start = last_before(fresh, place, self.start)[1:]
        self.at, self.start, self.source = self.at + n, start[-1], b["source"][n - 1].as_py()
        return place, start


def last_before(hit: np.ndarray, place: np.ndarray, carried: int) -> np.ndarray:
    """The last place with a hit before each row, and, at the end, after all of them."""
    return np.maximum.accumulate(np.concatenate(([carried], np.where(hit, place, -1))))


_SIDE = [("n_{0}", pa.int64()), ("head_{0}", pa.bool_()), ("open_{0}", pa.bool_()), ("piece_{0}", pa.string())]
_CHUNK = pa.schema(
    [("chunk", pa.int32()), ("first", pa.string()), ("last", pa.string()), *((name.format(i), kind) for i in (0, 1) for name, kind in _SIDE)]
)
CHUNK = "chunk INT, first STRING, last STRING, " + ", ".join(f"n_{i} BIGINT, head_{i} BOOLEAN, open_{i} BOOLEAN, piece_{i} STRING" for i in (0, 1))


def _describe(walk: Callable[[bool], Walk]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a chunk: for either bit, the lines before its first head, whether it has a head, and the bit after it."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks, chunk = (walk(False), walk(True)), None
        pieces: tuple[list[str], list[str]] = ([], [])
        headed = [False, False]
        for b in batches:
            if not b.num_rows:
                continue
            chunk = b["chunk"][0].as_py()
            for i, w in enumerate(walks):
                head, kept = w.batch(b)
                if not headed[i]:
                    at = int(head.argmax()) if head.any() else b.num_rows
                    headed[i] = bool(head.any())
                    pieces[i].extend(b["line"].filter(pa.array(kept & (np.arange(b.num_rows) < at))).to_pylist())
        if chunk is not None:
            row = [chunk, walks[0].first, walks[0].source]
            for i, w in enumerate(walks):
                row += [len(pieces[i]), headed[i], w.is_open, "\n".join(pieces[i])]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNK)], schema=_CHUNK)

    return describe


_ENTRY = pa.schema([("chunk", pa.int32()), ("edge", pa.int32()), ("source", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("n_lines", pa.int64())])
ENTRY = "chunk INT, edge INT, source STRING, line_no BIGINT, line STRING, n_lines BIGINT"


def _rows(walk_from: Callable[[bool], Walk], open_chunks: frozenset[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that begin in a chunk; ``open_chunks``: those that the bit enters."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, chunk = None, -1
        held: tuple[str, int, list[str]] | None = None

        def out(rows: list[tuple[str, int, list[str]]], edge: int) -> pa.RecordBatch:
            columns = [
                [chunk] * len(rows), [edge] * len(rows), [r[0] for r in rows], [r[1] for r in rows], ["\n".join(r[2]) for r in rows], [len(r[2]) for r in rows],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY)], schema=_ENTRY)

        for b in batches:
            if not b.num_rows:
                continue
            if walk is None:
                chunk = b["chunk"][0].as_py()
                walk = walk_from(chunk in open_chunks)
            head, kept = walk.batch(b)
            rows = pa.Table.from_batches([b]).filter(pa.array(kept))
            sources, numbers, lines = rows["source"].to_pylist(), rows["line_no"].to_pylist(), rows["line"].to_pylist()
            heads = np.flatnonzero(head[kept]).tolist()
            lead = heads[0] if heads else len(lines)
            if held:
                held[2].extend(lines[:lead])
            made = [(sources[a], numbers[a], lines[a:z]) for a, z in zip(heads, [*heads[1:], len(lines)])]
            if made:
                done = [held, *made[:-1]] if held else made[:-1]
                held = made[-1]
                if done:
                    yield out(done, 0)
        if held:
            yield out([held], _LAST)

    return make


def _resolve(chunks: list) -> tuple[frozenset[int], dict[int, tuple[int, int]]]:
    """The chunks that the bit enters, and for chunks that begin inside a row (owner of the row, bit)."""
    entered, owners = set(), {}
    before, owner = None, -1
    for c in sorted(chunks, key=lambda r: r["chunk"]):
        same = before is not None and before[0] == c["first"]
        bit = int(same and before[1])
        if bit:
            entered.add(c["chunk"])
        if c[f"n_{bit}"]:
            owners[c["chunk"]] = (owner, bit)
        if c[f"head_{bit}"]:
            owner = c["chunk"]
        before = (c["last"], c[f"open_{bit}"])
    return frozenset(entered), owners


def joined_lines(ranged: DataFrame, walk: Callable[[bool], Walk]) -> DataFrame:
    """(source, line_no, line, n_lines): one row for each head, with the lines that go on with it.

    ``ranged``: chunk, source, line_no, line, mark in the ranges of ``by_ranges``; already cut, as it is read more than
    once.  A row is one text, however many lines it has.  What reaches the driver is one short row a chunk.
    """
    shapes = ranged.mapInArrow(_describe(walk), CHUNK)
    entered, owners = _resolve(shapes.drop("piece_0", "piece_1").collect())
    made = ranged.mapInArrow(_rows(walk, entered), ENTRY)
    if owners:
        known = ranged.sparkSession.createDataFrame([(c, o, b) for c, (o, b) in owners.items()], "chunk INT, owner INT, bit INT")
        side = lambda name: F.when(F.col("bit") == 1, F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
        pieces = shapes.join(F.broadcast(known), "chunk").groupBy("owner").agg(
            F.array_sort(F.collect_list(F.struct("chunk", side("piece").alias("piece")))).alias("parts"), F.sum(side("n")).alias("more")
        )  # one piece a chunk, of the one row that goes on over all of them
        tails = pieces.select("owner", F.lit(_LAST).alias("last"), F.array_join(F.transform("parts", lambda x: x["piece"]), "\n").alias("tail"), "more")
        made = made.join(small_side(cut(tails), 1_000), (made["chunk"] == F.col("owner")) & (made["edge"] == F.col("last")), "left")
        made = made.withColumn("line", F.concat_ws("\n", "line", "tail")).withColumn("n_lines", F.col("n_lines") + F.coalesce("more", F.lit(0)))
    return made.select("source", "line_no", "line", "n_lines")
