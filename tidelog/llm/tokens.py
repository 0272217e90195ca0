"""Token ids of whole texts by a public byte-level BPE vocabulary (problem 8).

Method: a hierarchical-bitmap rank queue.  Each merge rank has a bucket of linked-list positions; the bits of
non-empty buckets form three levels of 64-bit words, of which find-first-set gives the next rank.  Entries whose
neighbours have changed are skipped when they come up, so a pre-token of n bytes takes O(n log n) whatever its length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files on driver and executors, and the file read there.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits a text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64


class RankQueue:
    """Positions by merge rank; ``pop`` gives the least rank's leftmost position."""

    def __init__(self, ranks: int):
        words = -(-ranks // 64)
        self.low, self.mid, self.top = [0] * words, [0] * (-(-words // 64)), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        m = (self.top & -self.top).bit_length() - 1
        word = m << 6 | (self.mid[m] & -self.mid[m]).bit_length() - 1
        rank = word << 6 | (self.low[word] & -self.low[word]).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] &= self.low[word] - 1
            if not self.low[word]:
                self.mid[m] &= self.mid[m] - 1
                if not self.mid[m]:
                    self.top &= self.top - 1
        return rank, position


class Encoder:
    """Byte-level BPE over a table of ranks; the rank of a byte sequence is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.split = regex.compile(SPLIT)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, queue = len(piece), self.queue
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a node is its first byte; end is the next node's
        pending: list[int] = [-1] * n  # rank of the node's pair with its right neighbour, -1 for none

        def offer(a: int) -> None:
            b = end[a]
            rank = ranks.get(piece[a : end[b]]) if b < n else None
            pending[a] = -1 if rank is None else rank
            if rank is not None:
                queue.push(rank, a)

        for a in range(n - 1):
            offer(a)
        while (item := queue.pop()) is not None:
            rank, a = item
            if pending[a] != rank:
                continue  # stale: the node was merged away or has another neighbour
            b = end[a]
            pending[b] = -1
            end[a] = end[b]
            if end[a] < n:
                before[end[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            out.append(ranks[piece[a : end[a]]])
            a = end[a]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for an empty or null one."""
        out: list[int] = []
        for token in self.split.findall(text or ""):
            ids = self.known.get(token)
            if ids is None:
                ids = self.merge(token.encode("utf-8", "replace"))
                if len(token) <= LONGEST_REMEMBERED:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[token] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a rank file, read once a worker."""
    lines = Path(vocabulary).read_bytes().splitlines()
    return Encoder({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)})


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids ARRAY<INT>): one row a document.

    ``documents``: doc_id, text; other columns are ignored.  Empty and null texts have an empty list; special
    tokens are ordinary text; repeated rows give repeated results.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            ids = pa.array([e.encode(t) for t in b["text"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], ids], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id BIGINT, ids ARRAY<INT>")
