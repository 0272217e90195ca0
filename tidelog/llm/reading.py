"""Reading level of posts (problem 10).

Method: a linear pairwise ranker.  It learns from pairs of graded posts which syntax and vocabulary features make a
text more demanding; isotonic regression calibrates its scores into bands.  As the score is linear, the score of
a post is the mean of its sentences' scores, so the calibrated cuts hold for sentences as well, and a post gets the
band that most of its own sentences have.  Quotes, signatures, markup and pasted code are taken off before.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import cut, small_side

#: Bounds of what the ranker is trained on: graded posts (by a hash of their id), pairs, and their sentences (all, or
#: about so many drawn by hash from whole posts); all that reaches the driver is below 40 MB.
MOST_GRADED, MOST_PAIRS = 1_500, 15_000
MOST_SENTENCES = 25_000
VOCABULARY_BUCKETS = 256
LEAST_WORDS = 40
#: A stretch without sentence marks of more words than this is judged in windows.
LONGEST_SENTENCE, WINDOW = 45, 8
BANDS = (1, 2, 3)

# Words that begin subordinate clauses or link arguments.
LINKS = frozenset(
    "although because since if which that whereas while unless therefore however nevertheless notwithstanding insofar whatever whose whom "
    "before after when where whether though thus hence moreover".split()
)
_VOWELS = re.compile("[aeiouy]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_QUOTE = re.compile(r"\[quote\b[^\]]*\]|\[/quote\]|<blockquote\b[^>]*>|</blockquote>", re.IGNORECASE)
_SAID = re.compile(r"^[ \t]*(?:on\b[^\n]{3,60}\bwrote|[^\s:]{1,40} (?:said|wrote|schrieb|a écrit|dijo))[ \t]*:[ \t]*$", re.IGNORECASE)
_SIGNATURE = re.compile(
    r"\n(?:_{4,}[ \t]*\n|--[ \t]*\n|--[\w.-]{1,40}[ \t]*(?=\n|$)|\[size=1\]|<hr ?/?>|sent from my [^\n]{1,40}(?=\n|$))", re.IGNORECASE
)
_CODE = re.compile(r"\[code\].*?(?:\[/code\]|\Z)|<(pre|code)>.*?(?:</\1>|\Z)|```.*?(?:```|\Z)", re.IGNORECASE | re.DOTALL)
_TRACE = re.compile(r"^[ \t]+at [\w.$]+\(.*$|^\tat .*$", re.MULTILINE)
_TAG = re.compile(r"\[/?[a-z*]+(?:=[^\]\n]*)?\]|</?[a-z]+(?:\s[^<>\n]*)?/?>|\*\*|__|~~|https?://\S+", re.IGNORECASE)
_CITE = re.compile(r"<cite>.*?</cite>", re.IGNORECASE | re.DOTALL)
_END = re.compile(r"(?:[.!?…]+[\"”')\]]*|[:;]-?[)(D])(?=\s|$)|\n\s*\n+")


def without_quotes(text: str) -> str:
    """The post without quoted text: marked lines, their introductions and quote blocks, also ones cut off inside."""
    lines: list[str] = []
    for line in text.split("\n"):
        if line.lstrip().startswith(">"):
            if lines and _SAID.match(lines[-1]):
                lines.pop()
            continue
        lines.append(line)
    text = "\n".join(lines)
    marks = list(_QUOTE.finditer(text))
    style = lambda m: m.group().lower().lstrip("</[")[:1]  # noqa: E731  q or b
    opens = [not m.group().startswith(("[/", "</")) for m in marks]
    left = {"q": 0, "b": 0}  # closing marks of each style that are still to come, less opening ones
    balance: list[dict[str, int]] = [{}] * len(marks)
    for i in range(len(marks) - 1, -1, -1):
        balance[i] = dict(left)
        left[style(marks[i])] += -1 if opens[i] else 1
    out, at, stack = [], 0, []
    for i, m in enumerate(marks):
        s = style(m)
        if opens[i]:
            if not stack:
                out.append(text[at : m.start()])
            stack.append(s)
        elif stack:
            if s in stack:
                cut_off = text[max(0, m.start() - 8) : m.start()].rstrip().endswith("[...]")
                need = max(0, balance[i][s]) if cut_off else None
                while stack:
                    top = stack.pop()
                    if top == s and (need is None or stack.count(s) <= need):
                        break
        else:
            out.append(text[at : m.start()])
        at = m.end()
    if not stack:
        out.append(text[at:])
    else:  # never closed: the quote ends where its paragraph does
        rest = text[at:].split("\n\n", 1)
        out.append(rest[1] if len(rest) > 1 else "")
    return "\n".join(out)


def own_text(text: str) -> str:
    """What the author wrote: without quotes, signature, pasted code and markup, entities resolved."""
    text = _CODE.sub("\n", without_quotes(text.replace("\r\n", "\n").replace("\r", "\n")))
    text = _TRACE.sub("", text)
    text = "\n".join(x for x in text.split("\n") if not _SAID.match(x))
    found = [m.start() for m in _SIGNATURE.finditer("\n" + text)]
    for start in found:
        if len(text[max(0, start - 1) :].strip().split("\n")) <= 5 or start == found[-1]:
            tail = text[start:].strip()
            if len(_WORD.findall(tail)) <= 16:
                text = text[: max(0, start - 1)]
                break
    text = _TAG.sub("", re.sub(r"<br ?/?>", "\n", _CITE.sub("", text), flags=re.IGNORECASE))
    return html.unescape(text).replace("\xa0", " ")


def sentences(text: str) -> list[tuple[list[str], int, bool]]:
    """(words, commas, whole): the sentences of a cleaned text; windows of stretches without sentence marks."""
    out, at = [], 0
    spans = []
    for m in _END.finditer(text):
        spans.append(text[at : m.end()])
        at = m.end()
    spans.append(text[at:])
    for span in spans:
        words = [w.lower() for w in _WORD.findall(span)]
        if not words:
            continue
        if len(words) <= LONGEST_SENTENCE:
            out.append((words, span.count(",") + span.count(";"), True))
        else:
            commas = (span.count(",") + span.count(";")) / len(words)
            parts = -(-len(words) // WINDOW)
            for k in range(parts):
                part = words[k * len(words) // parts : (k + 1) * len(words) // parts]
                out.append((part, round(commas * len(part)), False))
    return out


N_FEATURES = 10 + VOCABULARY_BUCKETS
#: Sentences whose features stand in memory at a time.
SENTENCES_AT_ONCE = 2000


def _word(w: str) -> tuple[float, ...]:
    """Letters, their logarithm, whether they are many, very many, few, vowel groups, link, "and", and bucket of a word."""
    n = len(w)
    return n, math.log(n), n >= 7, n >= 10, n <= 3, max(1, len(_VOWELS.findall(w))), w in LINKS, w == "and", crc32(w.encode()) % VOCABULARY_BUCKETS


class _Words:
    """What is known of the words met so far, as rows of one table; it begins anew when it is full."""

    MOST = 100_000

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((self.MOST, 9))

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self.rows) + len(words) > self.MOST:
            self.rows.clear()
            if len(words) > self.MOST:
                return np.array([_word(w) for w in words], float)
        rows = self.rows
        for w in words:
            if w not in rows:
                self.table[len(rows)] = _word(w)
                rows[w] = len(rows)
        return self.table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]


_words = _Words()


def features(found: list[tuple[list[str], int, bool]]) -> np.ndarray:
    """Syntax and vocabulary of sentences, one a row, as rates a word."""
    if not found:
        return np.zeros((0, N_FEATURES), np.float32)
    n = np.array([len(words) for words, _, _ in found])
    known = _words.look_up(list(chain.from_iterable(words for words, _, _ in found)))
    begins = np.cumsum(n) - n
    rates = np.add.reduceat(known[:, :8], begins, axis=0) / n[:, None]
    x = np.empty((len(found), N_FEATURES), np.float32)
    x[:, :5] = rates[:, :5]
    x[:, 5] = np.maximum.reduceat(known[:, 0], begins)
    x[:, 6] = rates[:, 5]
    x[:, 7] = np.array([commas for _, commas, _ in found]) / n
    x[:, 8:10] = rates[:, 6:8]
    places = np.repeat(np.arange(len(found)) * VOCABULARY_BUCKETS, n) + known[:, 8].astype(np.int64)
    x[:, 10:] = np.bincount(places, minlength=len(found) * VOCABULARY_BUCKETS).reshape(len(found), -1) / n[:, None]
    return x


class Ranker:
    """Weights of the linear score, its cuts between bands, and the words of an average sentence of each band."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cuts: tuple[float, float], lengths: tuple[float, float, float]):
        self.weights, self.cuts, self.lengths = weights / scale, cuts, lengths
        self.offset = float(mean @ self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights - self.offset

    def bands(self, posts: list[list[tuple[list[str], int, bool]]]) -> list[int]:
        """The band of most sentences of each post; windows count as the part of an average sentence that they are."""
        all_of = iter(np.searchsorted(self.cuts, self.score(features(list(chain.from_iterable(posts))))).tolist())
        out = []
        for found in posts:
            votes = [0.0, 0.0, 0.0]
            for (words, _, whole), k in zip(found, all_of):
                votes[k] += 1.0 if whole else len(words) / self.lengths[k]
            out.append(BANDS[int(np.argmax(votes))])
        return out


def isotonic(scores: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted scores and the non-decreasing step function of them nearest to the grades (pool adjacent violators)."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum, count
    for g in grades[order]:
        blocks.append([float(g), 1.0])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, c = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
    fitted = np.concatenate([np.full(int(c), s / c) for s, c in blocks]) if blocks else np.empty(0)
    return scores[order], fitted


def _cut(scores: np.ndarray, fitted: np.ndarray, level: float) -> float:
    above = np.flatnonzero(fitted >= level)
    if not len(above):
        return np.inf
    i = above[0]
    return -np.inf if i == 0 else float((scores[i - 1] + scores[i]) / 2)


def _rank(z: np.ndarray, grades: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Weights that put the higher graded of each pair above the other (logistic loss with the grades' distance)."""
    a, b = rng.integers(0, len(z), (2, MOST_PAIRS))
    keep = grades[a] != grades[b]
    a, b = a[keep], b[keep]
    low = grades[a] > grades[b]
    a, b = np.where(low, b, a), np.where(low, a, b)
    d, margin = z[b] - z[a], grades[b] - grades[a]
    w = np.zeros(z.shape[1])
    velocity = np.zeros_like(w)
    for _ in range(rounds if len(d) else 0):
        p = 1 / (1 + np.exp(np.clip(d @ w - margin, -30, 30)))
        velocity = 0.9 * velocity + (d * p[:, None]).mean(axis=0) - 0.01 * w
        w += 0.05 * velocity
    return w


class Graded(NamedTuple):
    """A graded post: its sentences' number, and the sums of their features and of the features' squares."""

    grade: float
    n: int
    sums: np.ndarray
    squares: np.ndarray


class Drawn(NamedTuple):
    """Sentences that are learnt from: features, (words, whole), and the grades of their posts."""

    x: np.ndarray
    sizes: list[tuple[int, bool]]
    grades: np.ndarray


def fit(posts: list[Graded], drawn: Drawn, rounds: int = 200, seed: int = 7) -> Ranker:
    """A ranker of graded posts and of sentences of theirs.

    Pairs of whole posts give a first score, which tells for each sentence whether it speaks for its post's grade;
    pairs of the sentences then give the score that is used.
    """
    rng = np.random.default_rng(seed)
    x, grades = drawn.x, np.array([p.grade for p in posts])
    total = sum(p.n for p in posts)
    means = np.array([p.sums / p.n for p in posts], np.float32)
    mean = sum(p.sums for p in posts) / total
    scale = np.sqrt(np.maximum(sum(p.squares for p in posts) / total - mean**2, 0.0)).astype(np.float32) + np.float32(0.02)
    mean = mean.astype(np.float32)
    first = Ranker(mean, scale, _rank((means - mean) / scale, grades, rounds, rng), (0.0, 0.0), (8.0, 16.0, 20.0))
    scores, fitted = isotonic(first.score(means), grades)
    cuts = (_cut(scores, fitted, 1.5), _cut(scores, fitted, 2.5))
    near = np.abs(np.searchsorted(cuts, first.score(x)) + 1 - drawn.grades) <= 1  # a sentence two bands off is a guest
    ranker = Ranker(mean, scale, _rank((x[near] - mean) / scale, drawn.grades[near], rounds, rng), cuts, first.lengths)
    scores, fitted = isotonic(ranker.score(x[near]), drawn.grades[near])
    ranker.cuts = (_cut(scores, fitted, 1.5), _cut(scores, fitted, 2.5))
    totals = [[0.0, 0.0] for _ in BANDS]
    bands = np.searchsorted(ranker.cuts, ranker.score(x))
    for k, (n, whole) in zip(bands, drawn.sizes):
        if whole:
            totals[k][0] += n
            totals[k][1] += 1
    ranker.lengths = tuple(t / c if c else old for (t, c), old in zip(totals, ranker.lengths))
    return ranker


def graded_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, grade): graded posts with the median of their grades; at most MOST_GRADED, by a hash of the id."""
    median = labels.where("band BETWEEN 1 AND 3").groupBy("doc_id").agg(F.percentile("band", 0.5).alias("grade"))
    bounded = median.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_GRADED)
    texts = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return cut(texts.join(small_side(bounded), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "grade"))


def graded_posts(graded: DataFrame) -> list[Graded]:
    """The graded posts of enough words, by id, each reduced over all of its sentences."""
    rows = graded.mapInArrow(_reduce, "doc_id BIGINT, grade DOUBLE, n BIGINT, sums BINARY, squares BINARY")
    return [Graded(grade, n, np.frombuffer(sums), np.frombuffer(squares)) for _, grade, n, sums, squares in sorted(rows.toLocalIterator())]


def drawn_sentences(graded: DataFrame, share: float) -> Drawn:
    """The share of all sentences of the graded posts, by a hash of post and place; all of them for a share of 1."""
    rows = sorted(graded.mapInArrow(_draw(share), "doc_id BIGINT, grade DOUBLE, x BINARY, sizes ARRAY<INT>").toLocalIterator())
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, N_FEATURES)
    sizes = [(abs(s), s > 0) for r in rows for s in r.sizes]
    return Drawn(x, sizes, np.repeat(np.array([r.grade for r in rows]), [len(r.sizes) for r in rows]))


def _graded(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, float, list[tuple[list[str], int, bool]]]]]:
    """By batch, (id, grade, sentences) of the posts of enough words."""
    for b in batches:
        posts = []
        for doc_id, text, grade in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "grade"))):
            found = sentences(own_text(text))
            if sum(len(words) for words, _, _ in found) >= LEAST_WORDS:
                posts.append((doc_id, grade, found))
        yield posts


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for posts in _graded(batches):
        out = []
        for doc_id, grade, found in posts:
            sums, squares = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
            for at in range(0, len(found), SENTENCES_AT_ONCE):
                x = features(found[at : at + SENTENCES_AT_ONCE]).astype(float)
                sums += x.sum(axis=0)
                squares += (x * x).sum(axis=0)
            out.append((doc_id, grade, len(found), sums.tobytes(), squares.tobytes()))
        yield _batch(out, doc_id=pa.int64(), grade=pa.float64(), n=pa.int64(), sums=pa.binary(), squares=pa.binary())


def chosen(doc_id: int, n: int, share: float) -> np.ndarray:
    """The places of a post's ``n`` sentences that are drawn."""
    mixed = (np.full(n, doc_id, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.arange(n, dtype=np.uint64)
    for _ in range(2):
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((mixed >> np.uint64(11)) < share * 2**53)


def _draw(share: float):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for posts in _graded(batches):
            out = []
            for doc_id, grade, found in posts:
                some = [found[k] for k in chosen(doc_id, len(found), share)]
                x = features(some).tobytes()
                out.append((doc_id, grade, x, [len(words) if whole else -len(words) for words, _, whole in some]))
            yield _batch(out, doc_id=pa.int64(), grade=pa.float64(), x=pa.binary(), sizes=pa.list_(pa.int32()))

    return draw


def reading_bands(documents: DataFrame, labels: DataFrame, lang: str = "en") -> DataFrame:
    """(doc_id, band): the band of each document of the language with at least LEAST_WORDS own words.

    ``documents``: doc_id, text, lang; ``labels``: doc_id, band (several a document); other columns are ignored.
    Null, empty and shorter texts have no band; without labels of two bands there is nothing to learn from, and the
    result is empty; repeated rows give repeated results.
    """
    graded = graded_texts(documents, labels)
    posts = graded_posts(graded)
    schema = "doc_id BIGINT, band INT"
    if len({p.grade for p in posts}) < 2:
        return documents.sparkSession.createDataFrame([], schema)
    ranker = fit(posts, drawn_sentences(graded, min(1.0, MOST_SENTENCES / sum(p.n for p in posts))))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bands, posts, held = [], [], [], 0
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                found = sentences(own_text(text or ""))
                if sum(len(words) for words, _, _ in found) >= LEAST_WORDS:
                    ids.append(doc_id)
                    posts.append(found)
                    held += len(found)
                if held >= SENTENCES_AT_ONCE:
                    bands += ranker.bands(posts)
                    posts, held = [], 0
            bands += ranker.bands(posts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bands, pa.int32())], names=["doc_id", "band"])

    return documents.where((F.col("lang") == lang) & (F.length("text") >= 2 * LEAST_WORDS - 1)).select("doc_id", "text").mapInArrow(judge, schema)
