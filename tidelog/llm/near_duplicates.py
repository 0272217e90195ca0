"""Texts that share most of their words: all pairs above a similarity, and the groups they form (problem 1).

Method: a MinHash LSH forest.  The signature of a text is a label in each of TREES sorted prefix tries; a pair is a
candidate where the labels share a prefix.  How far matched prefixes are shortened is adapted to each text, until
any partner above the threshold is met with the target recall.  Candidates are verified exactly on word sets.

Signatures are drawn from a text's rare words, as words that a large part of the corpus shares (log phrases) make
unrelated texts look alike.  A text whose rare words are too few for a guarantee uses all of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.session import cut, small_side

TREES = 96
DEEPEST = 4
DEPTH_ALL = 6
TARGET_RECALL = 0.999
#: Similarity from which depths and sketch places below are safe.
LEAST_THRESHOLD = 0.7
#: Members of a bucket that one task compares at a time; larger buckets are compared block by block.
BLOCK = 512
#: Share of the texts from which a word is frequent, and the most frequent words there can be.
FREQUENT, MOST_FREQUENT = 0.01, 100_000
SKETCH = 64
_LEAST_RARE, _LEAST_ALL = 4, 24  # equal sketch places that a candidate needs, in either forest


def words_of(text: Column) -> Column:
    """The distinct runs of [a-z0-9] of the lower-cased text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))))


def long_texts(df: DataFrame, kind: str, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(kind, id, key, words): texts of at least ``least_words`` distinct words, those as 64-bit hashes."""
    text = F.col(text_col)
    words = words_of(text)
    # n words with n - 1 characters between them; cheaper than the words, hence first
    df = df.where(F.length(text) >= 2 * least_words - 1).select(F.col(id_col).cast("bigint").alias("id"), words.alias("words"))
    df = df.where((F.size("words") >= least_words) & F.col("id").isNotNull())
    return df.select(
        F.lit(kind).alias("kind"),
        "id",
        F.md5(F.concat_ws(" ", "words")).alias("key"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("words"),
    )


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240917)
    n = TREES * max(DEEPEST, DEPTH_ALL)
    odd = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(words: np.ndarray, depth: int) -> np.ndarray:
    """(TREES, depth) minima of the hashed words under independent permutations."""
    odd, add = (x[: TREES * depth] for x in _permutations())
    low = None
    for part in range(0, len(words), 1024):
        mixed = words[part : part + 1024, None].view(np.uint64) * odd + add
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        least = mixed.min(axis=0)
        low = least if low is None else np.minimum(low, least)
    return low.reshape(depth, TREES).T


def guaranteed(rare: int, total: int, threshold: float) -> float:
    """Least similarity of the rare words of a text and of any partner above the threshold.

    A partner lacks l of the words and has e others, with (total - l) / (total + e) >= threshold; the worst case
    is at one of the ends.
    """
    lacks, others = (1 - threshold) * total, (1 / threshold - 1) * total
    return max(0.0, min((rare - lacks) / rare, rare / (rare + others))) if rare else 0.0


def depth_for(similarity: float, deepest: int = DEEPEST) -> int:
    """The longest prefix with which TREES tries meet the target recall at a similarity; 0 if none does."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - similarity**depth) ** TREES >= TARGET_RECALL:
            return depth
    return 0


def partner_share(threshold: float) -> float:
    """The greatest share of rare words that a partner of a text without a depth can have.

    The text has at most the share ``s`` of rare words.  A partner that lacks l of its words and has e others
    has at most (s + e) / (1 - l + e) of them, greatest at one of the ends of what the threshold allows.
    """
    s = max(x for x in range(101) if not depth_for(guaranteed(x, 100, threshold))) / 100 + 0.01
    most = 1 / threshold - 1
    return max(s / threshold, (s + most) / (1 + most))


def _own_depths(frequent: frozenset[int], threshold: float):
    """The number of texts of each depth."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.array(sorted(frequent), np.int64)
        own: dict[int, int] = {}
        for b in batches:
            for words in b["words"]:
                words = words.values.to_numpy()
                rare = len(words) - int(np.isin(words, common).sum())
                depth = depth_for(guaranteed(rare, len(words), threshold))
                own[depth] = own.get(depth, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array(list(own.values()), pa.int64())], names=["depth", "n"])

    return count


def _emit(frequent: frozenset[int], threshold: float, levels: dict[int, range], any_short: bool):
    """Forest rows of a text: bucket (tree, level and label prefix), class, mark and sketch.

    ``levels``: by a text's own depth, the prefix lengths under which it is filed.  ``mark``: own depth * 100 + level
    in the forest of rare words; 0 or -1 in that of all words, for a text that needs it or may be a partner of one.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, limit = np.array(sorted(frequent), np.int64), partner_share(threshold)
        trees = np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            buckets, kinds, ids, marks, sketches = [], [], [], [], []
            for kind, cls, words in zip(b["kind"].to_pylist(), b["cls"].to_pylist(), b["words"]):
                words = np.asarray(words.values.to_numpy(), np.int64)
                rare = words[~np.isin(words, common)] if len(common) else words
                own = depth_for(guaranteed(len(rare), len(words), threshold))
                files = [(rare, level, own * 100 + level) for level in levels.get(own, ())]
                if not own or (any_short and len(rare) <= limit * len(words)):
                    files.append((words, DEPTH_ALL, -1 if own else 0))
                signed: dict[int, np.ndarray] = {}
                for chosen, level, mark in files:
                    if id(chosen) not in signed:
                        signed[id(chosen)] = signature(chosen, DEPTH_ALL if chosen is words and mark <= 0 else DEEPEST)
                    s = signed[id(chosen)]
                    label = np.uint64(level * 1_000_003 + (mark <= 0)) + trees
                    for k in range(level):
                        label = (label ^ s[:, k]) * np.uint64(0xD6E8FEB86659FD93)
                        label ^= label >> np.uint64(32)
                    buckets.append(label.view(np.int64))
                    kinds += [kind] * TREES
                    ids += [cls] * TREES
                    marks += [mark] * TREES
                    sketches += [(s[:SKETCH, 0] & np.uint64(0xFF)).astype(np.uint8).tobytes()] * TREES
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(buckets) if buckets else [], pa.int64()), pa.array(kinds, pa.string()), pa.array(ids, pa.int64()),
                    pa.array(marks, pa.int32()), pa.array(sketches, pa.binary()),
                ],
                names=["bucket", "kind", "cls", "mark", "sketch"],
            )

    return rows


def _worth(a: np.ndarray, b: np.ndarray, alike: np.ndarray, deeper: bool) -> np.ndarray:
    """Whether pairs of marks with so many equal sketch places are candidates, at the level where the pair belongs."""
    level = (np.maximum if deeper else np.minimum)(a // 100, b // 100)
    return np.where(a > 0, (alike >= _LEAST_RARE) & (level == a % 100), (alike >= _LEAST_ALL) & ((a == 0) | (b == 0)))


def _pairs_table(kinds: list[str], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["kind", "a", "b"])


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _compare_sorted(deeper: bool):
    """Candidates of buckets of at most BLOCK members, which stand together; rows of a bucket at distance 1, 2, ..."""

    def candidates(table: pa.Table) -> pa.RecordBatch:
        kind = np.array(table["kind"].to_pylist(), object)
        bucket, cls, mark = (table[c].to_numpy() for c in ("bucket", "cls", "mark"))
        sketch, found = _sketches(table["sketch"]), []
        left = np.arange(len(bucket))
        step = 0
        while len(left):
            step += 1
            left = left[left + step < len(bucket)]
            left = left[(bucket[left] == bucket[left + step]) & (kind[left] == kind[left + step])]
            right = left + step
            alike = (sketch[left] == sketch[right]).sum(axis=1)
            ok = _worth(mark[left], mark[right], alike, deeper) & (cls[left] != cls[right])
            found.append((left[ok], right[ok]))
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, int)
        b = np.concatenate([y for _, y in found]) if found else np.empty(0, int)
        return _pairs_table(kind[a].tolist(), cls[a], cls[b])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            if not table.num_rows:
                continue
            # the last bucket may go on in the next batch
            bucket = table["bucket"].to_numpy()
            end = np.flatnonzero(bucket != bucket[-1])
            cut_at = int(end[-1]) + 1 if len(end) else 0
            kept = table.slice(cut_at)
            if cut_at:
                yield candidates(table.slice(0, cut_at))
        if kept is not None and kept.num_rows:
            yield candidates(kept)

    return compare


def _compare_blocks(deeper: bool):
    """Candidates of two blocks of a large bucket."""

    def compare(table: pa.Table) -> pa.Table:
        cls, mark, part = (table[c].to_numpy() for c in ("cls", "mark", "part"))
        sketch = _sketches(table["sketch"])
        first, second = table["first"][0].as_py(), table["second"][0].as_py()
        left, right = np.flatnonzero(part == first), np.flatnonzero(part == second)
        found = []
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            alike = (sketch[rows][:, None, :] == sketch[right][None, :, :]).sum(axis=2, dtype=np.int16)
            x, y = cls[rows][:, None], cls[right][None, :]
            ok = _worth(mark[rows][:, None], mark[right][None, :], alike, deeper) & ((x < y) if first == second else (x != y))
            i, j = np.nonzero(ok)
            found.append((cls[rows][i], cls[right][j]))
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
        b = np.concatenate([y for _, y in found]) if found else np.empty(0, np.int64)
        return pa.Table.from_batches([_pairs_table([table["kind"][0].as_py()] * len(a), a, b)])

    return compare


def filed_levels(depths: dict[int, int]) -> tuple[bool, dict[int, range]]:
    """(deeper, levels by own depth) from the number of texts of each depth.

    A pair must meet at one of its two depths, either of which gives the target recall.  Filing each text from the
    least depth of all down to its own makes pairs meet at the shallower one; filing it from its own to the
    greatest of all, at the deeper one.  The way with fewer rows is taken.
    """
    own = {d: n for d, n in depths.items() if d}
    if not own:
        return True, {}
    low, high = min(own), max(own)
    down = sum(n * (d - low + 1) for d, n in own.items())
    up = sum(n * (high - d + 1) for d, n in own.items())
    if down < up:
        return False, {d: range(low, d + 1) for d in own}
    return True, {d: range(d, high + 1) for d in own}


def frequent_words(classes: DataFrame, n: int, n_words: int) -> frozenset[int]:
    """Hashes of the words of at least FREQUENT of the texts; never more than MOST_FREQUENT, by the count of words."""
    least = max(FREQUENT * n, n_words / MOST_FREQUENT, 10)
    counts = classes.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return frozenset(r[0] for r in counts.where(F.col("n") >= least).select("w").collect())


PAIR = "kind STRING, a BIGINT, b BIGINT"


def class_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(kind, a, b): pairs of classes of at least the similarity, a < b.

    ``classes``: kind, cls, words (distinct 64-bit hashes); already cut, as it is read several times.  The target recall
    of the forest and of the sketches holds from ``LEAST_THRESHOLD`` on; a lower threshold is an error.
    """
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"the forest reaches its recall from a similarity of {LEAST_THRESHOLD} on")
    n, n_words = classes.agg(F.count("*"), F.sum(F.size("words"))).first()
    frequent = frequent_words(classes, n, n_words) if n else frozenset()
    counted = classes.mapInArrow(_own_depths(frequent, threshold), "depth INT, n BIGINT").groupBy("depth").agg(F.sum("n"))
    depths = {depth: count for depth, count in counted.collect()}
    deeper, levels = filed_levels(depths)
    forest = cut(
        classes.mapInArrow(_emit(frequent, threshold, levels, 0 in depths), "bucket BIGINT, kind STRING, cls BIGINT, mark INT, sketch BINARY")
    )
    # counted with partial sums before the shuffle, so that a hot bucket never stands in one task
    hot = small_side(cut(forest.groupBy("kind", "bucket").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK)))
    small = forest.join(hot, ["kind", "bucket"], "left_anti").repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    large = forest.join(hot, ["kind", "bucket"])
    large = large.withColumn("part", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "kind", "bucket", "cls", "mark", "sketch", "part",
        F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"),
    )
    found = small.mapInArrow(_compare_sorted(deeper), PAIR).unionByName(
        large.groupBy("kind", "bucket", "first", "second").applyInArrow(_compare_blocks(deeper), PAIR)
    )
    found = found.distinct()
    words = classes.select("kind", "cls", "words")
    left = words.select("kind", F.col("cls").alias("a"), F.col("words").alias("wa"))
    right = words.select("kind", F.col("cls").alias("b"), F.col("words").alias("wb"))
    pairs = found.join(left, ["kind", "a"]).join(right, ["kind", "b"])
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    either = F.size("wa") + F.size("wb") - F.col("shared")
    return pairs.where(F.col("shared") * 1000 >= either * round(threshold * 1000)).select("kind", "a", "b")


def similar_classes(texts: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Members (kind, id, cls) and pairs (kind, a, b) of the classes of equal word sets; a class is its least id."""
    texts = cut(texts)
    classes = texts.groupBy("kind", "key").agg(F.min("id").alias("cls"), F.min_by("words", "id").alias("words"))
    classes = cut(classes)
    members = texts.select("kind", "id", "key").join(classes.select("kind", "key", "cls"), ["kind", "key"]).select("kind", "id", "cls")
    return members, class_pairs(classes, threshold)


def similar_pairs(texts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(record_kind, id_a, id_b): every pair of records of at least the similarity, id_a < id_b, copies expanded.

    ``texts``: the result of :func:`long_texts`, or a union of several.  Shorter, empty and null texts have no
    pairs; texts of equal words are pairs; repeated ids count once.
    """
    texts = texts.dropDuplicates(["kind", "id"])
    members, pairs = similar_classes(texts, threshold)
    members, pairs = cut(members), cut(pairs)
    left = members.select("kind", F.col("cls").alias("a"), F.col("id").alias("x"))
    right = members.select("kind", F.col("cls").alias("b"), F.col("id").alias("y"))
    across = pairs.join(left, ["kind", "a"]).join(right, ["kind", "b"]).select("kind", "x", "y")
    within = left.withColumnRenamed("a", "b").join(right, ["kind", "b"]).where("x < y").select("kind", "x", "y")
    return across.unionByName(within).select(
        F.col("kind").alias("record_kind"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")
    )


def components(pairs: DataFrame) -> DataFrame:
    """(kind, cls, grp): the least class that each linked class is connected with, until nothing changes any more."""
    edges = cut(pairs.select("kind", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select("kind", F.col("b").alias("u"), F.col("a").alias("v"))))
    labels = cut(edges.groupBy("kind", F.col("u").alias("cls")).agg(F.least(F.min("v"), F.first("u")).alias("grp")))
    while True:
        near = edges.join(labels.select("kind", F.col("cls").alias("v"), "grp"), ["kind", "v"])
        least = near.groupBy("kind", F.col("u").alias("cls")).agg(F.min("grp").alias("near"))
        step = labels.join(least, ["kind", "cls"]).select("kind", "cls", F.least("grp", "near").alias("new"), "grp")
        # shortcut: the label of the label, which is never greater
        jump = labels.select("kind", F.col("cls").alias("new"), F.col("grp").alias("far"))
        step = step.join(jump, ["kind", "new"], "left").select("kind", "cls", F.least("new", F.coalesce("far", "new")).alias("new"), "grp")
        step = cut(step)
        changed = step.where("new < grp").limit(1).count()
        labels = step.select("kind", "cls", F.col("new").alias("grp"))
        if not changed:
            return labels


def similar_groups(texts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(record_kind, id, class_id, group_id, n_links): one row a long text.

    ``class_id`` is the least id with the same words, ``group_id`` the least class that links lead to, ``n_links``
    the number of other records that are alike.
    """
    members, pairs = similar_classes(texts.dropDuplicates(["kind", "id"]), threshold)
    members, pairs = cut(members), cut(pairs)
    sizes = members.groupBy("kind", "cls").agg(F.count("*").alias("copies"))
    both = pairs.select("kind", "a", "b").unionByName(pairs.select("kind", F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes.select("kind", F.col("cls").alias("b"), "copies"), ["kind", "b"]).groupBy("kind", F.col("a").alias("cls")).agg(F.sum("copies").alias("others"))
    facts = sizes.join(links, ["kind", "cls"], "left").join(components(pairs), ["kind", "cls"], "left")
    return members.join(facts, ["kind", "cls"]).select(
        F.col("kind").alias("record_kind"), "id", F.col("cls").alias("class_id"), F.coalesce("grp", "cls").alias("group_id"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
