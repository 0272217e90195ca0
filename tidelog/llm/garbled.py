"""Text decoded with the wrong character encoding: found and, where possible, restored (problem 7).

Method: a single-byte swap is a substitution cipher.  Its key, from characters shown to letters meant, is learnt by
expectation-maximisation against the bigrams of the corpus's clean text: which letter each character stands for is hidden,
its expectation follows from the neighbours' expected letters, and all are updated until they agree.  Tables of known code
pages are only where the learning starts; characters that the evidence reads differently leave them.  Texts that no table
explains are learnt from nothing, one key a source.  The learnt keys are applied with ``translate()``.  UTF-8 and other
multi-byte encodings aren't letter-to-letter: there a code page gives the bytes, the encoding gives the letters of whole
sequences.  Which cipher a source uses is weighed by a second expectation-maximisation.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import cut, small_side

#: Code pages that UTF-8 was shown in; bytes without a character there were kept as control characters.
UTF8_SHOWN = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp1254", "cp437", "cp850", "koi8_r")
#: (shown, meant) of single-byte swaps.
SINGLE_BYTE = (
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp1250"),
    ("cp1252", "cp1253"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
)
#: (shown, meant) of other multi-byte encodings.
MULTI_BYTE = (("cp1252", "cp932"), ("cp1252", "euc_jp"))
CIPHERS = tuple((p, "utf-8") for p in UTF8_SHOWN) + MULTI_BYTE + SINGLE_BYTE

#: Buckets of the bigram counts and of the sources' weights: what goes to the driver is bounded by them.
BIGRAM_BUCKETS = 1 << 18
SOURCE_BUCKETS = 1 << 11
#: Least log-likelihood gain for a cipher without structure of its own.
MARGIN = 6.0
ROUNDS = 2
#: Steps of the learning of a key: how much of the evidence each step believes.
STEPS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.0, 1.0, 1.0)
#: Nats that a table's letter is ahead of others, and that a letter loses where another character is read as it.
HEAD_START, TAKEN = 8.0, 3.0
#: Characters beyond ASCII that a source must show before a key is learnt from nothing.
LEAST_UNKNOWN = 200
#: The cipher of a source's own key, which no table gave.
UNKNOWN = -1
#: Least gain under a key that the text's own source taught.
OWN_MARGIN = 2.0
LOST = "�"

_RUN = re.compile(r"[^\x00-\x7f]+")
_UTF8 = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_PAIRS = {
    "cp932": re.compile("(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])+"),
    "euc_jp": re.compile("(?:[\xa1-\xfe][\xa1-\xfe]){2,}"),
}
#: Lead bytes of kana and frequent kanji as Windows shows them.
_LEADS = frozenset("ƒ‚Œ‹•–—“”¤¥")
_CONTROL = re.compile("[\x80-\x9f]")
#: Accented Latin letters and signs in a row that no Latin text has.
_ACCENTED = re.compile("[\xa1-\xff]{4}")
#: Characters that may stand beside garbled ones without being garbled themselves.
_ASIDE = frozenset("\xa0“”„‘’«»…–—¿¡·•")


@lru_cache(maxsize=64)
def bytes_table(page: str) -> dict[int, str]:
    """Key of a code page: its characters, and the control characters of C1, to their bytes as Latin-1."""
    table = {i: chr(i) for i in range(128, 160)}
    for byte in range(128, 256):
        try:
            table[ord(bytes([byte]).decode(page))] = chr(byte)
        except UnicodeDecodeError:
            table[byte] = chr(byte)
    if page == "cp1252":
        table |= {i: chr(i) for i in range(160, 256)}
    return table


@lru_cache(maxsize=64)
def letters_table(shown: str, meant: str) -> dict[int, str]:
    """Key of a single-byte swap: shown characters to the letters meant."""
    table = {}
    for char, byte in bytes_table(shown).items():
        try:
            table[char] = bytes([ord(byte)]).decode(meant)
        except UnicodeDecodeError:
            pass
    return table


# Blocks whose characters are ordinary in any corpus; others must occur in its clean text.
_ORDINARY = (
    (0x00, 0x24F), (0x370, 0x3FF), (0x400, 0x45F), (0x490, 0x491), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20A0, 0x20CF),
    (0x2100, 0x22FF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFFF), (0x1F000, 0x1FAFF),
)


def plausible(left: str, new: str, right: str, lm: Bigrams) -> bool:
    """Whether deciphered characters are ordinary or known, and Greek and Cyrillic letters don't touch ASCII ones."""
    for c in new:
        n = ord(c)
        if not any(a <= n <= b for a, b in _ORDINARY) and not lm.counts.get(_bucket(c, "")):
            return False
    touches = lambda c, d: c.isascii() and c.isalpha() and "\u0370" <= d <= "\u052f"
    return not (touches(left, new[:1]) or touches(right, new[-1:]))


def _bucket(a: str, b: str) -> int:
    return crc32(f"{a}{b}".encode("utf-8", "surrogatepass")) % BIGRAM_BUCKETS


class Bigrams:
    """Hashed bigram counts of clean text around characters beyond ASCII, and the keys of the single-byte swaps.

    ``keys``: by place in ``SINGLE_BYTE``, tables for ``translate()``; the code pages' own where none is given.
    """

    def __init__(self, counts: dict[int, int], keys: dict[int, dict[int, str]] | None = None):
        self.counts = counts
        self.keys = {k: letters_table(*c) for k, c in enumerate(SINGLE_BYTE)} if keys is None else keys

    @lru_cache(maxsize=100_000)  # noqa: B019
    def letters(self, run: str, k: int) -> str | None:
        """A run under a key; None if it isn't one of its texts."""
        return under_key(run, self.keys[k]) if k in self.keys else None

    @lru_cache(maxsize=100_000)  # noqa: B019
    def of(self, a: str, b: str) -> float:
        """Log-probability of ``b`` after ``a``; without evidence that of ``b`` by itself."""
        count = self.counts.get
        alone = (count(_bucket(b, ""), 0) + 0.05) / (count(_bucket("", ""), 0) + 50.0)
        return math.log((count(_bucket(a, b), 0) + 2.0 * alone) / (count(_bucket(a, ""), 0) + 2.0))

    def score(self, text: str) -> float:
        return sum(self.piece(text[max(0, m.start() - 1) : m.end() + 1]) for m in _RUN.finditer(text))

    @lru_cache(maxsize=200_000)  # noqa: B019
    def piece(self, text: str) -> float:
        """Log-likelihood of a run with a character on either side."""
        return sum(self.of(a, b) for a, b in zip(text, text[1:]))

    @lru_cache(maxsize=200_000)  # noqa: B019
    def single_byte_gains(self, left: str, run: str, right: str) -> tuple[float, ...]:
        """What each single-byte cipher gains on a run; 0 where it isn't one of its texts."""
        own = self.piece(f"{left}{run}{right}")
        out = []
        for k in range(len(SINGLE_BYTE)):
            new = self.letters(run, k)
            out.append(0.0 if new is None else self.piece(f"{left}{new}{right}") - own)
        return tuple(out)


@lru_cache(maxsize=100_000)
def _sequences(run: str, page: str) -> list[tuple[int, int, str]]:
    """Parts of a run that a page shows of valid UTF-8, if nothing but asides is left over."""
    view = run.translate(bytes_table(page))
    parts, at = [], 0
    for m in _UTF8.finditer(view):
        if any(c not in _ASIDE for c in run[at : m.start()]):
            return []
        try:
            parts.append((m.start(), m.end(), m.group().encode("latin-1").decode("utf-8")))
        except (UnicodeDecodeError, UnicodeEncodeError):
            return []
        at = m.end()
    return [] if any(c not in _ASIDE for c in run[at:]) else parts


@lru_cache(maxsize=100_000)
def _is_utf8(run: str) -> bool:
    """Whether any code page shows UTF-8 as this run."""
    return any(_sequences(run, p) for p in UTF8_SHOWN)


def under_key(run: str, table: dict[int, str]) -> str | None:
    """A run under a substitution; None if it holds other characters or nothing comes of it."""
    if not all(ord(c) in table for c in run):
        return None
    new = run.translate(table)
    return new if new != run and any(c.isalpha() for c in new) else None


def decipher(text: str, cipher: tuple[str, str], lm: Bigrams) -> list[tuple[int, int, str]]:
    """(start, end, letters) of the places that the cipher explains; empty if there are none."""
    shown, meant = cipher
    out = []
    if meant == "utf-8":
        for m in _RUN.finditer(text):
            out += [(m.start() + a, m.start() + b, s) for a, b, s in _sequences(m.group(), shown)]
    elif meant in _PAIRS:
        view = text.translate(bytes_table(shown))
        for m in _PAIRS[meant].finditer(view):
            if not any(c > "\x7f" for c in text[m.start() : m.end()]):
                continue
            try:
                out.append((m.start(), m.end(), m.group().encode("latin-1").decode(meant)))
            except (UnicodeDecodeError, UnicodeEncodeError):
                return []
    else:
        for m in _RUN.finditer(text):
            if new := lm.letters(m.group(), SINGLE_BYTE.index(cipher)):
                out.append((m.start(), m.end(), new))
    return out


def replaced(text: str, places: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, new in places:
        parts += [text[at:a], new]
        at = b
    return "".join(parts) + text[at:]


def _sound(text: str, places: list[tuple[int, int, str]], lm: Bigrams) -> bool:
    return all(plausible(text[max(0, a - 1) : a], new, text[b : b + 1], lm) for a, b, new in places)


def undo_utf8(text: str, lm: Bigrams) -> list[tuple[int, float, str]]:
    """(cipher, gain, letters) for each page that UTF-8 was shown in, undone as often as it was done.

    The gain is the log-likelihood of what comes out at last over that of ``text``; on the way to it characters
    may be implausible.
    """
    out = []
    if not any(_is_utf8(run) for run in _RUN.findall(text)):
        return out
    own = lm.score(text)
    for i, cipher in enumerate(CIPHERS[: len(UTF8_SHOWN)]):
        now, best = text, None
        while places := decipher(now, cipher, lm):  # each time makes the text shorter
            new = replaced(now, places)
            gain = lm.score(new) - own
            if gain > (best[1] if best else 0.0) and _sound(now, places, lm):
                best = (i, gain, new)
            now = new
        if best:
            out.append(best)
    return out


def odd_shape(left: str, run: str, right: str) -> bool:
    """Whether a run beyond ASCII looks like no word: a sign between letters, or many accented Latin letters in a row."""
    whole = f"{left}{run}{right}"
    signs = any(a.isalpha() and b.isalpha() and not c.isalpha() and c > "\x7f" and c != LOST and c not in _ASIDE for a, c, b in zip(whole, whole[1:], whole[2:]))
    return signs or bool(_ACCENTED.search(run))


def undo_unknown(text: str, lm: Bigrams, key: dict[int, str]) -> list[tuple[int, float, str]]:
    """The text under its source's own key, if that gains its margin."""
    places = [(m.start(), m.end(), new) for m in _RUN.finditer(text) if (new := under_key(m.group(), key))]
    if not places:
        return []
    new = replaced(text, places)
    gain = lm.score(new) - lm.score(text)
    return [(UNKNOWN, gain, new)] if gain > OWN_MARGIN else []


def candidates(text: str, lm: Bigrams, key: dict[int, str] | None = None) -> list[tuple[int, float, str]]:
    """(cipher, gain, letters): the ciphers that explain anything; ones without UTF-8's structure need the margin.

    ``key``: what the text's source taught about a swap that no table gives.
    """
    out = undo_utf8(text, lm)
    if out:
        return out
    first = len(UTF8_SHOWN)
    possible = []
    if any("\x80" <= c <= "\x9f" or c in _LEADS for c in text):
        possible += range(first, first + len(MULTI_BYTE))
    sums = [0.0] * len(SINGLE_BYTE)
    for m in _RUN.finditer(text):
        for k, g in enumerate(lm.single_byte_gains(text[max(0, m.start() - 1) : m.start()], m.group(), text[m.end() : m.end() + 1])):
            sums[k] += g
    possible += [first + len(MULTI_BYTE) + k for k, g in enumerate(sums) if g > MARGIN]
    for i in possible:
        places = decipher(text, CIPHERS[i], lm)
        if places and _sound(text, places, lm):
            new = replaced(text, places)
            gain = lm.score(new) - lm.score(text)
            if gain > MARGIN:
                out.append((i, gain, new))
    return out or (undo_unknown(text, lm, key) if key else [])


def choose(found: list[tuple[int, float, str]], weights: dict[int, float]) -> str:
    """The letters of the likeliest cipher."""
    return max(found, key=lambda x: x[1] + math.log(weights.get(x[0], 1.0 / len(CIPHERS))))[2]


def restore(text: str, lm: Bigrams, weights: dict[int, float], key: dict[int, str] | None = None) -> str:
    """The text with its likeliest ciphers undone, one after the other; each one makes it likelier, so there is an end."""
    while found := candidates(text, lm, key):
        text = choose(found, weights)
    return text


def uncovered(raw: str | None, message: str | None) -> list[re.Match]:
    """The runs of ``raw`` beyond those that ``message`` holds as well."""
    if not raw or raw.isascii():
        return []
    left = Counter(_RUN.findall(message or ""))
    out = []
    for m in _RUN.finditer(raw):
        if left[m.group()] > 0:
            left[m.group()] -= 1
        else:
            out.append(m)
    return out


def _clean_pairs(text: str, runs: Iterable[re.Match]) -> Iterator[tuple[str, str]]:
    """Bigrams of the runs beyond ASCII that no UTF-8 view explains, and of their neighbours."""
    for m in runs:
        run = m.group()
        if LOST in run or any("\x80" <= c <= "\x9f" for c in run) or _is_utf8(run) or odd_shape(text[max(0, m.start() - 1) : m.start()], run, text[m.end() : m.end() + 1]):
            continue
        a, b = max(0, m.start() - 1), m.end() + 1
        piece = text[a:b]
        yield from zip(piece, piece[1:])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for message, raw in zip(batch["message"].to_pylist(), batch["raw"].to_pylist()):
            for text, runs in ((message or "", _RUN.finditer(message or "")), (raw or "", uncovered(raw, message))):
                for a, b in _clean_pairs(text, runs):
                    counts[_bucket(a, b)] += 1
                    counts[_bucket(a, "")] += 1
                    counts[_bucket("", "")] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["bucket", "n"])


def source_bucket(source: str | None) -> int:
    return crc32((source or "").encode()) % SOURCE_BUCKETS


def proposal(text: str, lm: Bigrams) -> int | None:
    """The single-byte swap whose table gains most on a text, and more than the margin; UNKNOWN for odd shapes, else None."""
    sums, odd = [0.0] * len(SINGLE_BYTE), False
    for m in _RUN.finditer(text):
        left, run, right = text[max(0, m.start() - 1) : m.start()], m.group(), text[m.end() : m.end() + 1]
        odd = odd or odd_shape(left, run, right)
        for k, g in enumerate(lm.single_byte_gains(left, run, right)):
            sums[k] += g
    most = max(sums)
    return sums.index(most) if most > MARGIN else UNKNOWN if odd and most <= 0 else None


def _suspects(lm: Bigrams):
    """The fields beyond ASCII, with the single-byte swap that they are evidence for, if any."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sources, ids = batch["source"].to_pylist(), batch["entry_id"].to_pylist()
            messages = batch["message"].to_pylist()
            for field in ("message", "raw"):
                for source, entry_id, text, message in zip(sources, ids, batch[field].to_pylist(), messages):
                    if not text or text.isascii():
                        continue
                    proposed = None if undo_utf8(text, lm) else proposal(text, lm)
                    learnt = field == "message" or bool(uncovered(text, message))
                    out.append((entry_id, field, source, text, proposed, learnt))
            columns = list(zip(*out)) if out else [()] * len(_SUSPECT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUSPECT)], schema=_SUSPECT)

    return find


SUSPECT = "entry_id BIGINT, field STRING, source STRING, text STRING, proposed INT, learnt BOOLEAN"
_SUSPECT = pa.schema(
    [("entry_id", pa.int64()), ("field", pa.string()), ("source", pa.string()), ("text", pa.string()), ("proposed", pa.int32()), ("learnt", pa.bool_())]
)
JUDGED = "entry_id BIGINT, field STRING, s INT, text STRING, ciphers ARRAY<INT>, gains ARRAY<DOUBLE>, letters ARRAY<STRING>, learnt BOOLEAN, key STRING"
_JUDGED = pa.schema(
    [("entry_id", pa.int64()), ("field", pa.string()), ("s", pa.int32()), ("text", pa.string()), ("ciphers", pa.list_(pa.int32())),
     ("gains", pa.list_(pa.float64())), ("letters", pa.list_(pa.string())), ("learnt", pa.bool_()), ("key", pa.string())]
)


def _evidence(lm: Bigrams):
    """Pairs of neighbouring characters of the runs that are evidence for a swap; only an unknown one is a source's own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for source, text, proposed in zip(batch["source"].to_pylist(), batch["text"].to_pylist(), batch["proposed"].to_pylist()):
                for m in _RUN.finditer(text):
                    left, run, right = text[max(0, m.start() - 1) : m.start()], m.group(), text[m.end() : m.end() + 1]
                    if _CONTROL.search(run) or proposed != UNKNOWN and lm.single_byte_gains(left, run, right)[proposed] <= 0:
                        continue  # a text may be garbled in part
                    piece = f"{left}{run}{right}"
                    for pair in zip(piece, piece[1:]):
                        if LOST not in pair:
                            counts[(source if proposed == UNKNOWN else None, proposed, *pair)] += 1
        columns = list(zip(*((*k, n) for k, n in counts.items()))) if counts else [()] * 5
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["source", "proposed", "a", "b", "n"])

    return count


def alphabet(lm: Bigrams) -> list[str]:
    """The letters beyond ASCII of the clean text."""
    blocks = ((0xC0, 0x24F), (0x370, 0x3FF), (0x400, 0x45F))
    return [c for lo, hi in blocks for c in map(chr, range(lo, hi + 1)) if c.isalpha() and lm.counts.get(_bucket(c, ""), 0) > 1]


def learn_key(pairs: dict[tuple[str, str], int], start: dict[int, str], lm: Bigrams, letters: list[str]) -> dict[int, str]:
    """The key that pairs of neighbouring characters reveal, by expectation-maximisation from a table or from nothing.

    Hidden is the letter of each character beyond ASCII; ASCII stands for itself.  A character's expected letter follows from
    how well each letter goes with the expected letters of its neighbours; the share of the evidence that is believed grows
    from step to step, so that first guesses don't stick.
    """
    shown = sorted({c for pair in pairs for c in pair})
    hidden = [c for c in shown if c > "\x7f"]
    if not hidden or not (letters or start):
        return {}
    meant = sorted(set(letters) | {c for c in shown if c <= "\x7f"} | {start[ord(c)] for c in hidden if ord(c) in start})
    place, at = {c: i for i, c in enumerate(meant)}, {c: i for i, c in enumerate(shown)}
    log_p = np.array([[lm.of(x, y) for y in meant] for x in meant])
    n = np.zeros((len(shown), len(shown)))
    for (a, b), count in pairs.items():
        n[at[a], at[b]] += count
    own = np.array([at[c] for c in hidden])
    known = set(letters)
    can = np.array([c in known for c in meant])
    prior = np.where(can, 0.0, -np.inf) * np.ones((len(hidden), 1))
    for i, c in enumerate(hidden):
        if ord(c) in start:
            prior[i, place[start[ord(c)]]] = HEAD_START
    q = np.zeros((len(shown), len(meant)))
    for c in shown:
        if c <= "\x7f":
            q[at[c], place[c]] = 1.0

    def believe(scores: np.ndarray) -> np.ndarray:
        odds = np.exp(scores - scores.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    q[own] = believe(prior)
    for share in STEPS:
        fits = (n @ q @ log_p.T + n.T @ q @ log_p)[own]
        taken = q[own].sum(axis=0) - q[own]
        q[own] = believe(share * fits + prior - TAKEN * taken)
    return {**start, **{ord(c): meant[int(q[at[c]].argmax())] for c in hidden}}


def _unknown_key(lm: Bigrams, letters: list[str]):
    """The key of one source, from the pairs of its odd texts; none without evidence enough."""

    def learn(table: pa.Table) -> pa.Table:
        pairs = dict(zip(zip(table["a"].to_pylist(), table["b"].to_pylist()), table["n"].to_pylist()))
        enough = sum(n for (a, _), n in pairs.items() if a > "\x7f") >= LEAST_UNKNOWN
        key = learn_key(pairs, {}, lm, letters) if enough else {}
        return pa.table({"source": [table["source"][0].as_py()], "key": ["".join(chr(c) + z for c, z in sorted(key.items()))]}, schema=_KEY)

    return learn


_KEY = pa.schema([("source", pa.string()), ("key", pa.string())])


def read_key(text: str | None) -> dict[int, str] | None:
    """A key that travelled as pairs of characters."""
    return {ord(c): z for c, z in zip(text[::2], text[1::2])} if text else None


def learn_keys(suspects: DataFrame, lm: Bigrams) -> tuple[Bigrams, DataFrame]:
    """The bigrams with the learnt keys of the swaps that have a table, and (source, key) of those that have none.

    What reaches the driver are pairs of characters by swap, not by source.
    """
    pairs = suspects.where("learnt AND proposed IS NOT NULL").select("source", "text", "proposed")
    counts = cut(pairs.mapInArrow(_evidence(lm), "source STRING, proposed INT, a STRING, b STRING, n BIGINT").groupBy("source", "proposed", "a", "b").agg(F.sum("n").alias("n")))
    known: dict[int, dict] = {}
    for _, k, a, b, n in counts.where(F.col("proposed") != UNKNOWN).collect():
        known.setdefault(k, {})[a, b] = n
    letters = alphabet(lm)
    learnt = Bigrams(lm.counts, {k: learn_key(found, letters_table(*SINGLE_BYTE[k]), lm, letters) for k, found in known.items()})
    own = counts.where((F.col("proposed") == UNKNOWN) & F.col("source").isNotNull()).groupBy("source").applyInArrow(_unknown_key(lm, letters), "source STRING, key STRING")
    return learnt, own


def _judge(lm: Bigrams):
    """The suspects that are garbled, with the candidates of their first cipher under the learnt keys."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for entry_id, field, source, text, learnt, key in zip(*(batch[c].to_pylist() for c in ("entry_id", "field", "source", "text", "learnt", "key"))):
                found = candidates(text, lm, read_key(key))
                if found or LOST in text:
                    numbers, gains, letters = zip(*found) if found else ((), (), ())
                    out.append((entry_id, field, source_bucket(source), text, numbers, gains, letters, learnt, key))
            columns = list(zip(*out)) if out else [()] * len(_JUDGED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _JUDGED)], schema=_JUDGED)

    return judge


def learn_bigrams(texts: DataFrame) -> Bigrams:
    """Bigrams of the clean messages of the whole corpus, and of what raw holds besides them; bounded by their buckets."""
    counted = texts.mapInArrow(_count, "bucket BIGINT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n"))
    return Bigrams({r[0]: r[1] for r in counted.collect()})


def _expect(weights: dict[tuple[int, int], float]):
    """E step: the expected number of garbled texts by source and cipher."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for s, ciphers, gains in zip(batch["s"].to_pylist(), batch["ciphers"].to_pylist(), batch["gains"].to_pylist()):
                if not ciphers:
                    continue
                logs = [g + math.log(weights.get((s, i), 1.0 / len(CIPHERS))) for i, g in zip(ciphers, gains)]
                odds = [math.exp(x - max(logs)) for x in logs]
                for i, o in zip(ciphers, odds):
                    sums[s, i] += o / sum(odds)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k] for k in keys], pa.float64())],
            names=["s", "cipher", "x"],
        )

    return step


def learn_weights(suspects: DataFrame) -> dict[tuple[int, int], float]:
    """Each source's weights of the ciphers; bounded by the source buckets."""
    weights: dict[tuple[int, int], float] = {}
    seen = suspects.where("learnt").select("s", "ciphers", "gains")
    for _ in range(ROUNDS):
        sums = seen.mapInArrow(_expect(weights), "s INT, cipher INT, x DOUBLE").groupBy("s", "cipher").agg(F.sum("x").alias("x")).collect()
        total: Counter = Counter()
        for s, _, x in sums:
            total[s] += x
        weights = {(s, i): (x + 1.0) / (total[s] + len(CIPHERS)) for s, i, x in sums}
    return weights


RESTORED = "entry_id BIGINT, field STRING, restorable INT, restored STRING"


def restored_fields(entries: DataFrame) -> DataFrame:
    """(entry_id, field, restorable, restored): the fields 'message' and 'raw' that hold wrongly decoded text.

    ``entries``: entry_id, source, message, raw; other columns are ignored.  ``restorable`` is 0 if replacement
    characters stand in the text, which then is restored as far as possible.  Null, empty and ASCII texts are
    never garbled; a null source is a source of its own; repeated rows give repeated results.
    """
    beyond = F.col("message").rlike(r"[^\x00-\x7F]") | F.col("raw").rlike(r"[^\x00-\x7F]")
    texts = cut(entries.where(beyond).select("entry_id", "source", "message", "raw"))
    lm = learn_bigrams(texts.select("message", "raw"))
    suspects = cut(texts.mapInArrow(_suspects(lm), SUSPECT))
    learnt, own = learn_keys(suspects, lm)
    judged = cut(suspects.join(small_side(cut(own)), "source", "left").mapInArrow(_judge(learnt), JUDGED))
    weights = learn_weights(judged)

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for s, text, key, *found in zip(*(batch[c].to_pylist() for c in ("s", "text", "key", "ciphers", "gains", "letters"))):
                own = {i: w for i in (UNKNOWN, *range(len(CIPHERS))) if (w := weights.get((s, i)))}
                new.append(restore(choose(list(zip(*found)), own) if found[0] else text, learnt, own, read_key(key)))
            ok = [0 if LOST in x else 1 for x in new]
            yield pa.RecordBatch.from_arrays(
                [batch["entry_id"], batch["field"], pa.array(ok, pa.int32()), pa.array(new, pa.string())],
                names=["entry_id", "field", "restorable", "restored"],
            )

    return judged.mapInArrow(undo, RESTORED)
