"""Texts put into containers of fixed capacity with little unused space (problem 9).

Method: space-filling-curve order.  Hashed document vectors are projected to three dimensions, documents are
range-sorted by their Hilbert key, and neighbours along the curve are packed together: best fit, longest first,
within a window that moves along the curve.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tokens import VOCABULARY, encoder
from tidelog.session import cut

DIMENSIONS, BITS = 3, 10
#: Items of one window, and containers' worth of tokens of one range.
WINDOW, LEAST_CONTAINERS = 2048, 256
#: Containers that stay open for the windows to come; their items are written, only their room is kept.
MOST_OPEN = 256
#: Items of a range, from which on there are more ranges than the session's shuffle partitions.
ITEMS_OF_RANGE = 500_000
#: Most sizes of containers; they are read to the driver.
MOST_SIZES = 1000


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of grid points, one a row, on the Hilbert curve (transposed Gray code)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def project(texts: list[list[int]]) -> np.ndarray:
    """Grid points of texts: their token counts under hashed random signs, scaled by their norm; zero for empty ones."""
    lengths = np.array([len(x) for x in texts], np.int64)
    pairs = np.repeat(np.arange(len(texts), dtype=np.int64), lengths) << 32 | np.fromiter(chain.from_iterable(texts), np.int64, int(lengths.sum()))
    pairs, counts = np.unique(pairs, return_counts=True)
    doc = pairs >> 32
    mixed = (pairs & 0xFFFFFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    weight = np.log1p(counts)
    norm = np.sqrt(np.bincount(doc, weight**2, len(texts)))
    out = np.zeros((len(texts), DIMENSIONS), np.int64)
    for d in range(DIMENSIONS):
        sign = ((mixed >> np.uint64(40 + d)) & np.uint64(1)).astype(np.int64) * 2 - 1
        z = np.bincount(doc, weight * sign, len(texts)) / np.where(norm > 0, norm, 1.0)  # about standard normal
        out[:, d] = np.where(lengths > 0, np.clip((z + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1), 0)
    return out


def measured(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, curve): length in tokens and place on the curve of each document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            ids = [e.encode(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array(hilbert_keys(project(ids)), pa.int64())],
                names=["doc_id", "n_tokens", "curve"],
            )

    return documents.select("doc_id", "text").mapInArrow(measure, "doc_id BIGINT, n_tokens BIGINT, curve BIGINT")


def best_fit(items: list[tuple[int, tuple]], capacity: int, rooms: Sequence[int] = ()) -> list[tuple[int, list[tuple]]]:
    """Containers (free space, items) of items (size, what), longest first into the fullest that has room.

    ``rooms``: the free space of containers begun before; they stand first in the result, with their new items.
    """
    free = sorted((room, k) for k, room in enumerate(rooms))
    out: list[tuple[int, list[tuple]]] = [(room, []) for room in rooms]
    for size, what in sorted(items, key=lambda x: (-x[0], x[1])):
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, k = free.pop(at)
        else:
            room, k = capacity, len(out)
            out.append((capacity, []))
        out[k][1].append(what)
        out[k] = (room - size, out[k][1])
        if room > size:
            insort(free, (room - size, k))
    return out


PACKED = "size_name STRING, container BIGINT, doc_id BIGINT, piece_no INT, start_token BIGINT, n_tokens BIGINT"
_PACKED_ARROW = pa.schema(
    [("size_name", pa.string()), ("container", pa.int64()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64())]
)


def _pack(size_name: str, capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk, waiting, opened = 0, 0, [], []

        def settle(last: bool) -> pa.RecordBatch:
            """Pack what waits.  What is nearly full is closed; the rest waits for the neighbours to come.

            A rest of too many items is written, and its containers stay open, as (free space, number).
            """
            nonlocal number, waiting, opened
            done = best_fit(waiting, capacity, [room for room, _ in opened])
            begun = [(room, n, items) for (room, items), (_, n) in zip(done, opened)]
            new = done[len(opened) :]
            rest = [] if last else [c for c in new if c[0] * 100 > capacity]
            if sum(len(items) for _, items in rest) > WINDOW // 2:
                rest = []
            held = {id(c) for c in rest}
            for c in new:
                if id(c) not in held:
                    begun.append((c[0], number, c[1]))
                    number += 1
            waiting = [(what[3], what) for _, items in rest for what in items]
            opened = sorted(((room, n) for room, n, _ in begun if room * 100 > capacity), reverse=True)[:MOST_OPEN]
            out = [(size_name, chunk << 33 | n, *what) for _, n, items in begun for what in items]
            columns = list(zip(*out)) if out else [()] * len(_PACKED_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED_ARROW)], schema=_PACKED_ARROW)

        for b in batches:
            if b.num_rows:
                chunk = b["chunk"][0].as_py()
            for doc_id, piece_no, start, n in zip(*(b[c].to_pylist() for c in ("doc_id", "piece_no", "start_token", "size"))):
                waiting.append((n, (doc_id, piece_no, start, n)))
                if len(waiting) >= WINDOW:
                    yield settle(False)
        yield settle(True)

    return pack


def packed(documents: DataFrame, sizes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(size_name, container, doc_id, piece_no, start_token, n_tokens): where each piece of each text goes.

    ``documents``: doc_id, text; ``sizes``: size_name, capacity_tokens; other columns are ignored.  A text is one
    piece unless it alone exceeds the capacity; then its pieces but the last fill a container each.  Empty and
    null texts have no tokens and need no container: their container is null.  Repeated rows are packed each.
    Sizes without a positive capacity are left out.
    """
    found = sizes.where("capacity_tokens > 0").select("size_name", "capacity_tokens").distinct().limit(MOST_SIZES + 1).collect()
    if len(found) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} sizes")
    docs = cut(measured(documents, vocabulary))
    n_docs, total = docs.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    most_ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_docs // ITEMS_OF_RANGE)
    out = docs.sparkSession.createDataFrame([], PACKED)
    for size_name, capacity in sorted((tuple(r) for r in found), key=lambda r: (r[1], str(r[0]))):
        empty = docs.where("n_tokens = 0").select(
            F.lit(size_name).alias("size_name"), F.lit(None).cast("bigint").alias("container"), "doc_id",
            F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start_token"), "n_tokens",
        )
        number = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int")))
        pieces = docs.where("n_tokens > 0").select("doc_id", "curve", "n_tokens", number.alias("piece_no"))
        start = F.col("piece_no").cast("bigint") * capacity
        pieces = pieces.select("doc_id", "curve", "piece_no", start.alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - start).alias("size"))
        ranges = int(max(1, min(most_ranges, total // (capacity * LEAST_CONTAINERS))))
        ranged = pieces.repartitionByRange(ranges, "curve", "doc_id", "piece_no").sortWithinPartitions("curve", "doc_id", "piece_no")
        ranged = ranged.withColumn("chunk", F.spark_partition_id().cast("bigint"))
        out = out.unionByName(ranged.mapInArrow(_pack(size_name, capacity), PACKED)).unionByName(empty)
    return out


def fill(packed_: DataFrame, sizes: DataFrame) -> DataFrame:
    """(size_name, n_containers, n_tokens, fill): how full the containers of each size are."""
    per = packed_.where("container IS NOT NULL").groupBy("size_name").agg(F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return per.join(sizes.select("size_name", "capacity_tokens"), "size_name").select(
        "size_name", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill")
    )
