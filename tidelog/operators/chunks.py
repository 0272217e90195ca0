"""Runs over ordered groups, without a task that holds a whole group.

Rows are range-partitioned by (group, place), so that a group of any size is spread over as many chunks as its
rows need.  Each chunk encodes its runs locally.  Only a chunk's first and last run can go on in a neighbour;
these edge runs, at most two a chunk, are merged by an associative operation, level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import cut, estimated_bytes

#: Chunks whose edge runs one task merges; the number of levels is the logarithm of the chunks to this base.
FANOUT = 256
#: Estimated bytes, then rows, of a range up to which a task sorts it in memory.
RANGE_BYTES, RANGE_ROWS = 128 << 20, 1_000_000
#: The key of a row that goes on with whatever run precedes it in its group.
GOES_ON = -1
FIRST, LAST = 1, 2  # bits of ``edge``: the run touches the beginning, the end of its chunk

RUN = (
    "chunk INT, edge INT, grp BIGINT, key BIGINT, first_no BIGINT, last_no BIGINT, n BIGINT, t_min BIGINT, "
    "t_max BIGINT, tag STRING"
)
_NUMBERS = ("grp", "key", "first_no", "last_no", "n", "t_min", "t_max")
RUN_ARROW = pa.schema(
    [("chunk", pa.int32()), ("edge", pa.int32()), *((c, pa.int64()) for c in _NUMBERS), ("tag", pa.string())]
)
GRP, KEY, FIRST_NO, LAST_NO, N, T_MIN, T_MAX, TAG = range(8)
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def ranges_for(df: DataFrame) -> int | None:
    """The number of ranges that keeps each one sortable in a task's memory; None for the session's number.

    The plan's own estimate costs nothing; only if it is beyond what the session's number takes are the rows counted.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if estimated_bytes(df) <= usual * RANGE_BYTES:
        return None
    needed = -(-df.count() // RANGE_ROWS)
    return needed if needed > usual else None


def by_ranges(df: DataFrame, group: str, place: str | tuple[str, ...], *ties: str) -> DataFrame:
    """``df`` in sorted ranges of (group, place), numbered by the column ``chunk``; ``ties`` order equal places."""
    places = (place,) if isinstance(place, str) else place
    order: list[Column] = [F.col(c).asc_nulls_first() for c in (group, *places)]
    n = ranges_for(df)
    ranged = df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order, *ties).withColumn("chunk", F.spark_partition_id())


def goes_on(a: tuple, b: tuple) -> bool:
    """Whether run ``b`` continues run ``a``, its neighbour before it."""
    return a[GRP] == b[GRP] and b[KEY] in (a[KEY], GOES_ON)


def joined(a: tuple, b: tuple) -> tuple:
    """Two neighbouring runs as one; associative."""
    low = min((x for x in (a[T_MIN], b[T_MIN]) if x is not None), default=None)
    high = max((x for x in (a[T_MAX], b[T_MAX]) if x is not None), default=None)
    return (a[GRP], a[KEY], a[FIRST_NO], b[LAST_NO], a[N] + b[N], low, high, a[TAG])


def encode_sorted(rows: pa.Table, before: tuple[int, int] | None = None) -> list[tuple]:
    """Runs of sorted rows (grp, no, key, t, tag); rows of the place of the row before count once."""
    grp, no = rows["grp"].to_numpy(), rows["no"].to_numpy()
    fresh = np.ones(len(grp), bool)
    fresh[1:] = (grp[1:] != grp[:-1]) | (no[1:] != no[:-1])
    if before and len(grp) and before == (grp[0], no[0]):
        fresh[0] = False
    if not fresh.all():
        rows = rows.filter(pa.array(fresh))
        grp, no = grp[fresh], no[fresh]
    if not len(grp):
        return []
    key = rows["key"].to_numpy()
    new = np.ones(len(grp), bool)
    new[1:] = (grp[1:] != grp[:-1]) | ((key[1:] != key[:-1]) & (key[1:] != GOES_ON))
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(grp))
    low = np.minimum.reduceat(pc.fill_null(rows["t"], _HIGH).to_numpy(), at)
    high = np.maximum.reduceat(pc.fill_null(rows["t"], _LOW).to_numpy(), at)
    none = (low == _HIGH) & (high == _LOW)
    columns = (grp[at], key[at], no[at], no[end - 1], end - at)
    low, high = (np.where(none, None, x.astype(object)) for x in (low, high))
    return list(zip(*(c.tolist() for c in columns), low.tolist(), high.tolist(), rows["tag"].take(pa.array(at)).to_pylist()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(RUN_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUN_ARROW)], schema=RUN_ARROW)


def encode_chunk(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that encodes one chunk batch by batch, holding one open run."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, open_run, first, before = -1, None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = batch["chunk"][0].as_py()
            runs = encode_sorted(pa.Table.from_batches([batch]), before)
            before = (batch["grp"][-1].as_py(), batch["no"][-1].as_py())
            if not runs:
                continue
            if open_run and goes_on(open_run, runs[0]):
                runs[0] = joined(open_run, runs[0])
            elif open_run:
                runs.insert(0, open_run)
            open_run = runs.pop()
            out = [(chunk, 0, *r) for r in runs[first:] if r[N] >= least]
            if first and runs:
                out.insert(0, (chunk, FIRST, *runs[0]))
                first = False
            if out:
                yield _batch(out)
        if open_run:
            yield _batch([(chunk, LAST | FIRST * first, *open_run)])

    return encode


def merge_edges(table: pa.Table) -> pa.Table:
    """Edge runs of a block of neighbouring chunks, joined; the block's own first and last run stay open."""
    rows = [tuple(r.values()) for r in table.select(RUN_ARROW.names).to_pylist()]
    rows.sort(key=lambda r: (r[0], not r[1] & FIRST))
    runs: list[tuple] = []
    for _, edge, *run in rows:
        if runs and edge & FIRST and goes_on(runs[-1], tuple(run)):
            runs[-1] = joined(runs[-1], tuple(run))
        else:
            runs.append(tuple(run))
    last = len(runs) - 1
    out = [(rows[0][0], FIRST * (i == 0) | LAST * (i == last), *r) for i, r in enumerate(runs)]
    return pa.Table.from_batches([_batch(out)], RUN_ARROW)


def close_edges(runs: DataFrame, least: int = 1) -> DataFrame:
    """Runs of all chunks with their edges joined, in levels of ``FANOUT`` chunks a task: grp, key, ..., tag."""
    runs = cut(runs)  # read more than once, and the ranges must not be drawn anew
    closed, edges = [runs.where("edge = 0")], runs.where("edge > 0")
    top = edges.agg(F.max("chunk")).first()[0]
    while top is not None:
        edges = edges.withColumn("_tl_block", F.floor(F.col("chunk") / FANOUT))
        merged = edges.groupBy("_tl_block").applyInArrow(merge_edges, RUN)
        if top < FANOUT:
            closed.append(merged)
            break
        merged = cut(merged)
        closed.append(merged.where("edge = 0"))
        edges = merged.where("edge > 0").withColumn("chunk", F.floor(F.col("chunk") / FANOUT).cast("int"))
        top //= FANOUT
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out.where(F.col("n") >= least).drop("chunk", "edge")


def runs_in_order(df: DataFrame, least: int = 1) -> DataFrame:
    """Runs of equal neighbouring keys: grp, key, first_no, last_no, n, t_min, t_max, tag (of the first row).

    ``df``: chunk, grp, no, key (BIGINT), t (BIGINT, nullable) and tag (STRING), in the ranges of
    :func:`by_ranges`.  A row with key ``GOES_ON`` belongs to the run before it in its group.  Rows of the same
    place count once, the first of them.  Runs of fewer than ``least`` rows are left out.
    """
    return close_edges(df.select("chunk", "grp", "no", "key", "t", "tag").mapInArrow(encode_chunk(least), RUN), least)


def number_within(df: DataFrame, group: str, place: str | tuple[str, ...], name: str) -> DataFrame:
    """``df`` with the number of each row within its group, in the order of ``place``; a hot group spreads over chunks.

    Rows are numbered within their chunk; what the chunks before hold of the group is added, from a table of about as
    many rows as there are chunks and groups in them.
    """
    ranged = cut(by_ranges(df, group, place).withColumn("_tl_at", F.monotonically_increasing_id()))
    own = F.row_number().over(Window.partitionBy(group, "chunk").orderBy("_tl_at"))
    counts = ranged.groupBy(group, "chunk").agg(F.count("*").alias("_tl_n"))
    earlier = Window.partitionBy(group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col(group).alias("_tl_g"), F.col("chunk").alias("_tl_c"), F.coalesce(F.sum("_tl_n").over(earlier), F.lit(0)).alias("_tl_before"))
    both = ranged.withColumn("_tl_own", own).join(before, (F.col(group) == F.col("_tl_g")) & (F.col("chunk") == F.col("_tl_c")))
    return both.withColumn(name, F.col("_tl_before") + F.col("_tl_own")).drop("_tl_at", "_tl_own", "_tl_g", "_tl_c", "_tl_before", "chunk")
