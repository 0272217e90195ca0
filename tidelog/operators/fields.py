"""Log lines of many layouts -> entries with timestamp, severity, component and message (problem 5).

Method: a fixed-depth template tree.  A first pass masks all tokens of all lines, routes each line by its number of
tokens and its leading tokens to a leaf, and merges similar templates, within partitions and then over all of them; words
that differ become places that vary.  Each merged template gives a map of positions to fields, and the headers of all
maps make one small trie.  The second pass takes the fields of each line by that trie.  Lines without a header go on with
the entry before them; the stretches are closed across chunk boundaries by ``tidelog.operators.chunks``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice
from operator import eq
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.chunks import GOES_ON, by_ranges, runs_in_order

# Level words, their abbreviations and single letters, by severity label.
LEVEL_WORDS = {
    "Error": "ERROR ERR ERRO FATAL FTL CRITICAL CRIT CRT EMERG EMERGENCY ALERT PANIC SEVERE E F C A",
    "Warning": "WARN WARNING WRN W",
    "Info": "INFO INFORMATION INFORMATIONAL INF NOTICE I N",
    "Debug": "DEBUG DBG D",
    "Trace": "TRACE TRC T",
}
SEVERITY_OF = {word: label for label, words in LEVEL_WORDS.items() for word in words.split()}
# Keys of structured lines, the first that is present counts.
TIME_KEYS = ("timestamp", "time", "@timestamp", "ts")
LEVEL_KEYS = ("level", "severity", "priority", "lvl")
TEXT_KEYS = ("message", "msg", "text")
COMPONENT_KEYS = ("component", "logger", "service", "app", "program", "module")

#: Depth of the tree: so many leading tokens, after the number of tokens, choose the leaf.
DEPTH = 3
#: Lines with more tokens share the last branch of the first level; their templates have so many positions.
MOST_TOKENS = 64
#: Positions in which a header ends.
HEADER = 10
#: Share of equal tokens from which a line merges into a template of its leaf.
SIMILAR = 0.5
#: Where the lines of a template differ.
VARIES = "<*>"

_ESCAPES = re.compile(r"\x1b(?:\[[0-9;?]*[ -/]*[@-~]|\][^\x07]*\x07|[@-Z\\-_])|\x1b|\x07|\x08|\ufeff|\x00")
#: One of these stands in each match of the pattern; to look for them is cheaper.
_ESCAPED = ("\x1b", "\x07", "\x08", "\ufeff", "\x00")
_TOKEN = re.compile(r"\S+")
_LEVEL = "|".join(sorted((w for w in SEVERITY_OF if len(w) > 1), key=len, reverse=True))
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
#: Masks of a token, the first that fits; a named mask may be a constant part of a template.
_MASKS = [
    (mask, re.compile(rx))
    for mask, rx in (
        ("<PRI>V", r"<\d{1,3}>\d{1,2}$"),
        ("<PRI>MON", r"<\d{1,3}>[A-Z][a-z]{2}$"),
        ("<ISO>", r"\[?\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:[Zz]|[+-]\d\d:?\d\d)?\]?:?$"),
        ("<DATE>", r"\[?(?:\d{4}[-/]\d\d[-/]\d\d|\d\d[-/.]\d\d[-/.]\d{4})$"),
        ("<TIME>", r"\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?\]?$"),
        ("<CLF>", r"\[\d\d/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d$"),
        ("<OFFSET>", r"[+-]\d{4}\]$"),
        ("<IP>", r"(?:\d{1,3}\.){3}\d{1,3}$|[0-9a-fA-F:]*:[0-9a-fA-F:]*:[0-9a-fA-F]*$"),
        ("<PIDTID>", r"\d+#\d+:$"),
        ("<UUID>", r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
        ("<NUM>", r"\d+$"),
        ("<MON>", rf"(?:{_MONTHS})$"),
        ("<DAY>", r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)$"),
        ("<LEVEL>", rf"(?i:{_LEVEL})$"),
        ("[<LEVEL>]", rf"\[(?:(?i:{_LEVEL})|[A-Z])\]$"),
        ("<LEVEL>:<NAME>:", rf"(?i:{_LEVEL}):[\w.$/-]+:"),
        ("<TAG>:", r"[A-Za-z][\w.$/-]*\[\d+\]:$"),
        ("<KEY>=", r"[A-Za-z@][\w.@-]*="),
        ("<OBJECT>", r"\{"),
        ("[<*>]", r"\[[^\[\]]*\]$"),
        ("<NAME>:", r"[A-Za-z][\w.$/-]*:$"),
    )
]
_PAIR = re.compile(r'([A-Za-z@][\w.@-]*)=("(?:[^"\\]|\\.)*"|\S*)')
_STATUS = re.compile(r'"(?:[^"\\]|\\.)*" (\d{3}) (?:\d+|-)')
_TAG = re.compile(r"^([^\[:\s]*)(?:\[[^\]]*\])?:?$")


class Header(NamedTuple):
    """What a line that begins an entry says."""

    timestamp: str
    severity: str
    component: str
    message: str


class Template:
    """A masked line with ``<*>`` where its lines differ."""

    __slots__ = ("tokens", "lines", "merges")

    def __init__(self, tokens: list[str], lines: int = 0):
        self.tokens, self.lines, self.merges = list(tokens), lines, 0

    def likeness(self, tokens: list[str]) -> float:
        """Share of equal tokens."""
        return sum(map(eq, self.tokens, tokens)) / max(1, len(tokens))

    def merge(self, tokens: list[str], lines: int = 1) -> None:
        self.lines += lines
        if self.tokens != tokens:
            merged = [a if a == b else VARIES for a, b in zip(self.tokens, tokens)]
            self.merges += merged != self.tokens
            self.tokens = merged


def is_mask(token: str) -> bool:
    """Words stand in templates behind an equals sign, all else is a mask; a place that varies is none."""
    return token[0] != "=" and token != VARIES


def clean_line(line: str) -> str:
    """The line without terminal escapes and remains of line ends."""
    if any(c in line for c in _ESCAPED):
        line = _ESCAPES.sub("", line)
    return line.rstrip("\r\n")


_ZERO = bytes.maketrans(b"123456789", b"000000000")


@lru_cache(maxsize=100_000)
def mask(shape: bytes) -> str:
    """The mask of a token, whose digits are all zeros; a word stays itself, anything else varies."""
    token = shape.decode("utf-8", "surrogatepass")
    for name, rx in _MASKS:
        if rx.match(token):
            return name
    return VARIES if "0" in token else f"={token}"


def shapes(line: str, most: int) -> list[bytes]:
    """The first tokens of a line, with zeros in place of digits, which makes nearly all tokens known ones."""
    text = line if line.isascii() else " ".join(line.split())  # bytes know only the white space of ASCII
    return text.encode("utf-8", "surrogatepass").translate(_ZERO).split(None, most)[:most]


def masked(line: str, most: int) -> list[str]:
    """The masks of the first tokens of a line."""
    return list(map(mask, shapes(line, most)))


def severity_of_level(level: str) -> str:
    return SEVERITY_OF.get(level.strip("[]: ").upper(), "Unknown")


def severity_of_priority(text: str) -> str:
    """By the low three bits of a syslog priority; one that isn't a byte counts as 0."""
    number = int(text)
    low = number & 7 if number <= 255 else 0
    return ("Error", "Error", "Error", "Error", "Warning", "Info", "Info", "Debug")[low]


def severity_of_status(status: int) -> str:
    return "Error" if 500 <= status <= 599 else "Warning" if 400 <= status <= 499 else "Info"


@lru_cache(maxsize=10_000)
def _positions(ts: tuple[int, int], level: int | None, component: int | None, message: int) -> Callable:
    """Fields at token positions; ``ts`` is the first and last token of the timestamp."""

    def fields(line: str, spans: list[tuple[int, int]]) -> Header:
        at = lambda i: line[spans[i][0] : spans[i][1]]
        stamp = line[spans[ts[0]][0] : spans[ts[1]][1]].strip("[]:")
        name = "" if component is None else _TAG.sub(r"\1", at(component).strip("[]"))
        return Header(
            stamp,
            "Unknown" if level is None else severity_of_level(at(level)),
            "" if name == "-" else name,
            line[spans[message][0] :] if message < len(spans) else "",
        )

    return fields


def _syslog(version: bool) -> Callable:
    def fields(line: str, spans: list[tuple[int, int]]) -> Header:
        at = lambda i: line[spans[i][0] : spans[i][1]]
        priority = re.match(r"<(\d+)>", line).group(1)
        if version:
            name, stamp, rest = at(3), at(1), line[spans[5][1] :].strip()
            rest = re.sub(r"^(?:-|(?:\[(?:[^\]\\]|\\.)*\])+)\s*", "", rest)
            name = "" if name == "-" else name
        else:
            stamp = line[spans[0][0] + len(priority) + 2 : spans[2][1]]
            name, rest = _TAG.sub(r"\1", at(4)), line[spans[4][1] :].strip()
        return Header(stamp, severity_of_priority(priority), name, rest)

    return fields


def _access(line: str, spans: list[tuple[int, int]]) -> Header | None:
    status = _STATUS.search(line)
    stamp = re.search(r"\[([^\]]+)\]", line)
    if not status or not stamp:
        return None
    return Header(stamp.group(1), severity_of_status(int(status.group(1))), "", line[stamp.end() :].strip())


def _labelled(line: str, spans: list[tuple[int, int]]) -> Header:
    level, name, message = line.split(":", 2)
    return Header("", severity_of_level(level), name, message)


def _first(record: dict, keys: tuple[str, ...]) -> str | None:
    for key in keys:
        if key in record:
            return record[key]
    return None


def _structured(record: dict) -> Header | None:
    """Fields of a record of keys and values; None unless it says when, or how severe and what."""
    stamp, level, text = (_first(record, keys) for keys in (TIME_KEYS, LEVEL_KEYS, TEXT_KEYS))
    if stamp is None and (level is None or text is None):
        return None
    component = _first(record, COMPONENT_KEYS)
    return Header(
        "" if stamp is None else str(stamp),
        severity_of_level(level) if isinstance(level, str) else "Unknown",
        component.strip() if isinstance(component, str) else "",
        text if isinstance(text, str) else "",
    )


def _object(line: str, spans: list[tuple[int, int]]) -> Header | None:
    try:
        record = json.loads(line, strict=False)
    except (ValueError, RecursionError):
        return None
    return _structured(record) if isinstance(record, dict) else None


def _pairs(line: str, spans: list[tuple[int, int]]) -> Header | None:
    record: dict = {}
    for key, value in _PAIR.findall(line):
        if value[:1] == '"':
            value = re.sub(r"\\(.)", r"\1", value[1:-1])
        record.setdefault(key, value)
    return _structured(record)


class Layout(NamedTuple):
    """Where the fields of a header stand: tokens of the timestamp, level and component, and the first of the message."""

    kind: str
    end: int
    ts: tuple[int, int] | None = None
    level: int | None = None
    component: int | None = None


_LEVELS, _BRACKETS = ("<LEVEL>", "[<LEVEL>]"), ("[<*>]", "[<LEVEL>]")
#: Masks that stand for a time, and what may follow them as parts of it.
_TIMES = (("<DATE>", "<TIME>"), ("<ISO>",), ("<DAY>", "<MON>", "<NUM>", "<TIME>", "<NUM>"), ("<MON>", "<NUM>", "<TIME>"))


def _is_word(token: str) -> bool:
    return not is_mask(token) and not _is_separator(token)


def _is_separator(token: str) -> bool:
    """Punctuation that is the same in all lines of a template."""
    return token[:1] == "=" and not any(c.isalnum() for c in token)


@lru_cache(maxsize=100_000)
def branch(token: str) -> str:
    """A word, whichever it is, is one branch; masks and punctuation are their own."""
    return VARIES if _is_word(token) else token


@lru_cache(maxsize=100_000)
def _branch_of(shape: bytes) -> str:
    return branch(mask(shape))


def _time_at(m: list[str], i: int) -> int:
    """The number of tokens of the time that begins at a position; 0 if none does."""
    return next((len(t) for t in _TIMES if tuple(m[i : i + len(t)]) == t), 0)


def layout(template: list[str]) -> Layout | None:
    """The position map of a merged template; None if it begins no entry.

    Lines that describe themselves (objects, pairs, syslog, access lines) are told by their masks.  In all others a
    header is a time, maybe after a level, then cells between separators, levels, process numbers, bracketed parts and names
    that end with a colon, until a token is none of these; constant punctuation separates, words name.
    """
    m = [*template[:HEADER], *[""] * 7]
    if m[0] in ("<OBJECT>", "<KEY>=", "<LEVEL>:<NAME>:"):
        return Layout(m[0], 1)
    if m[0] == "<PRI>V" and m[1] in ("<ISO>", "=-") and m[5]:
        return Layout("<PRI>V", 6)
    if m[0] == "<PRI>MON" and m[1] == "<NUM>" and m[2] == "<TIME>" and m[4]:
        return Layout("<PRI>MON", 5)
    if m[3] == "<CLF>" or m[0] == "<IP>" and "<CLF>" in m:
        return Layout("<CLF>", m.index("<CLF>") + 1)
    first = int(m[0] in _LEVELS)
    n = _time_at(m, first)
    if not n:
        return None
    level, component, i = (0 if first else None), None, first + n
    while i < len(template[:HEADER]):
        t, after, third = m[i : i + 3]
        if level is None and t in _LEVELS:
            level = i
        elif _is_separator(t) and third == t:  # a cell between two separators
            if level is None and after in _LEVELS:
                level = i + 1
            elif component is None and (_is_word(after) or after in _BRACKETS):
                component = i + 1
            i += 1
            if m[i + 3] != t:  # no cell follows
                i += 2
                break
        elif level is not None and t == "<NUM>" and _is_separator(after):  # a process number
            i += 1
        elif t in _BRACKETS and _is_word(after) and third == "=:":
            component, i = i + 1, i + 3
            break
        elif t in _BRACKETS and level is not None:
            component, i = i, i + 1
            break
        elif t == "<TAG>:" or t == "<NAME>:":
            component, i = i, i + 1
            break
        elif t == "<PIDTID>":
            i += 1
            break
        elif level is None and after in _LEVELS:  # an id, a thread or a host
            pass
        elif level is None and _is_word(t) and after == "<TAG>:":  # a host
            component, i = i + 1, i + 2
            break
        else:
            break
        i += 1
    return Layout("", i, (first, first + n - 1), level, component)


_OWN = {
    "<OBJECT>": _object, "<KEY>=": _pairs, "<LEVEL>:<NAME>:": _labelled, "<PRI>V": _syslog(True), "<PRI>MON": _syslog(False), "<CLF>": _access,
}


#: So many leading tokens tell a line that describes itself.
_TELLING = {"<OBJECT>": 1, "<KEY>=": 1, "<LEVEL>:<NAME>:": 1, "<PRI>V": 2, "<PRI>MON": 3}


def extract(line: str, at: Layout) -> Header | None:
    """The fields of a line by the positions of its layout; None if it doesn't bear them."""
    spans = [x.span() for x in islice(_TOKEN.finditer(line), at.end + 1)]
    if at.kind:
        if len(spans) < at.end:
            return None
        return _OWN[at.kind](line, spans)
    return _positions(at.ts, at.level, at.component, at.end)(line, spans)


class TemplateTree:
    """Number of tokens -> leading masked tokens -> structure of the header -> templates; the depth is fixed.

    Only words merge: where the masks of the header differ, lines have different layouts.
    """

    def __init__(self) -> None:
        self.leaves: dict[tuple, list[Template]] = {}
        self.known: dict[tuple, Template] = {}

    def add(self, tokens: list[str], lines: int = 1) -> Template:
        """Route tokens to their leaf and merge them into the likest of its templates, or begin a new one."""
        exact = tuple(tokens)
        if found := self.known.get(exact):
            found.lines += lines
            return found
        leaf = self.leaves.setdefault((len(tokens), *tokens[:DEPTH], *map(branch, tokens[DEPTH:HEADER])), [])
        most, found = SIMILAR, None
        for template in leaf:
            likeness = template.likeness(tokens)
            if likeness > most or (found is None and likeness == most):
                most, found = likeness, template
        if found is None:
            found = Template(tokens)
            leaf.append(found)
        found.merge(tokens, lines)
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[exact] = found
        return found

    def learn(self, raw: str | None) -> None:
        if line := header_line(raw):
            self.add(masked(line, MOST_TOKENS))

    def templates(self) -> Iterator[Template]:
        return (t for leaf in self.leaves.values() for t in leaf)


def header_line(raw: str | None) -> str | None:
    """The cleaned line if it may begin an entry: it isn't empty and not indented."""
    if not raw or raw[0] in " \t":
        return None
    line = clean_line(raw)
    return line if line and line[0] not in " \t" else None


class Layouts:
    """The layouts of all templates as a trie over header tokens; a word, whichever it is, is one branch."""

    def __init__(self, headers: Iterable[tuple[tuple[str, ...], Layout]]):
        self.root: dict = {}
        for tokens, at in headers:
            node = self.root
            for t in tokens:
                node = node.setdefault(t, {})
            node[None] = at
        self.found: dict[tuple[str, ...], Layout | None] = {}

    def find(self, line: str) -> Layout | None:
        """The layout of the longest header that the line begins with."""
        header = tuple(map(_branch_of, shapes(line, HEADER)))
        if header not in self.found:
            if len(self.found) > 100_000:
                self.found.clear()
            self.found[header] = self._longest(self.root, header, 0)[1]
        return self.found[header]

    def _longest(self, node: dict, header: tuple[str, ...], i: int) -> tuple[int, Layout | None]:
        """(length, layout) of the longest header from a node; punctuation may also stand where words vary."""
        best = (i, node[None]) if None in node else (-1, None)
        if i < len(header):
            for t in (header[i],) if is_mask(header[i]) else {header[i]: 0, VARIES: 0}:
                if t in node:
                    best = max(best, self._longest(node[t], header, i + 1), key=lambda x: x[0])
        return best

    def parse(self, raw: str | None) -> Header | None:
        """Fields of a line that begins an entry; None for one that goes on, and for null."""
        line = header_line(raw)
        at = self.find(line) if line else None
        return extract(line, at) if at else None


def header_of(template: list[str]) -> tuple[tuple[str, ...], Layout] | None:
    """The header of a merged template and its layout."""
    at = layout(template)
    return at and (tuple(branch(t) for t in template[: _TELLING.get(at.kind, at.end)]), at)


TEMPLATES = "leaf STRING, tokens ARRAY<STRING>, lines BIGINT, merges BIGINT"
_TEMPLATES_ARROW = pa.schema([("leaf", pa.string()), ("tokens", pa.list_(pa.string())), ("lines", pa.int64()), ("merges", pa.int64())])


def _template_rows(tree: TemplateTree) -> pa.RecordBatch:
    rows = [("\x01".join([str(len(t.tokens)), *t.tokens[:DEPTH]]), t.tokens, t.lines, t.merges) for t in tree.templates()]
    columns = list(zip(*rows)) if rows else [()] * len(_TEMPLATES_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TEMPLATES_ARROW)], schema=_TEMPLATES_ARROW)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = TemplateTree()
    for b in batches:
        for raw in b["raw"].to_pylist():
            tree.learn(raw)
    yield _template_rows(tree)


def _merge_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole leaves of the trees of all partitions, merged into one tree."""
    tree = TemplateTree()
    for b in batches:
        for tokens, lines, merges in zip(b["tokens"].to_pylist(), b["lines"].to_pylist(), b["merges"].to_pylist()):
            tree.add(tokens, lines).merges += merges
    yield _template_rows(tree)


def learn_templates(lines: DataFrame) -> DataFrame:
    """(leaf, tokens, lines, merges): the one tree of all lines, its leaves merged over the partitions.

    Within a leaf the templates of most lines come first, so that the result doesn't depend on the order of partitions.
    """
    grown = lines.select("raw").mapInArrow(_grow, TEMPLATES)
    return grown.repartition("leaf").sortWithinPartitions("leaf", F.desc("lines"), "tokens").mapInArrow(_merge_leaves, TEMPLATES)


_HEADERS = "tokens ARRAY<STRING>, kind STRING, ends INT, ts ARRAY<INT>, level INT, component INT"


def _header_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.string()), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
    names = ["tokens", "kind", "ends", "ts", "level", "component"]
    for b in batches:
        found = {h for t in b["tokens"].to_pylist() if (h := header_of(t))}
        columns = list(zip(*((list(tokens), at.kind, at.end, at.ts and list(at.ts), at.level, at.component) for tokens, at in found))) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def learn_layouts(lines: DataFrame) -> Layouts:
    """The layouts of all headers that occur; sequences of masks, of which there are few however many lines there are."""
    rows = learn_templates(lines).mapInArrow(_header_rows, _HEADERS).distinct().collect()
    return Layouts(
        (tuple(r["tokens"]), Layout(r["kind"], r["ends"], r["ts"] and tuple(r["ts"]), r["level"], r["component"])) for r in rows
    )


PARSED = "chunk INT, grp BIGINT, no BIGINT, key BIGINT, t BIGINT, tag STRING"
_PARSED_ARROW = pa.schema(
    [("chunk", pa.int32()), ("grp", pa.int64()), ("no", pa.int64()), ("key", pa.int64()), ("t", pa.int64()), ("tag", pa.string())]
)


def _parse_lines(layouts: Layouts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [layouts.parse(x) for x in b["raw"].to_pylist()]
            ids, places = b["line_id"].to_pylist(), b["no"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b["chunk"], b["grp"], b["no"],
                    pa.array([GOES_ON if h is None else abs(n) for h, n in zip(heads, places)], pa.int64()),
                    pa.nulls(b.num_rows, pa.int64()),
                    pa.array([None if h is None else json.dumps([i, *h]) for h, i in zip(heads, ids)], pa.string()),
                ],
                schema=_PARSED_ARROW,
            )

    return parse


def entries_of_lines(lines: DataFrame) -> DataFrame:
    """(line_id, file_id, line_no, last_no, n_lines, timestamp, severity, component, message): one row an entry.

    ``lines``: line_id, file_id, line_no, raw; other columns are ignored.  An entry reaches to the line before
    the next one or the end of its file; lines before the first entry of a file belong to none.  ``timestamp``
    is the text as it stands, '' if there is none; ``message`` is that of the first line.  Lines without file or
    number have no place and are left out; null, empty and blank lines go on with the entry before them; of lines
    of the same place the one with the least line_id counts.
    """
    placed = lines.where("file_id IS NOT NULL AND line_no IS NOT NULL").select(
        F.col("file_id").cast("bigint").alias("grp"), F.col("line_no").cast("bigint").alias("no"), "line_id", "raw"
    )
    parsed = by_ranges(placed, "grp", "no", "line_id").mapInArrow(_parse_lines(learn_layouts(lines)), PARSED)
    runs = runs_in_order(parsed).where(F.col("key") != GOES_ON)
    head = F.from_json("tag", "ARRAY<STRING>")
    return runs.withColumn("_tl_head", head).select(
        F.get("_tl_head", F.lit(0)).cast("bigint").alias("line_id"),
        F.col("grp").alias("file_id"),
        F.col("first_no").alias("line_no"),
        "last_no",
        F.col("n").cast("int").alias("n_lines"),
        *(F.get("_tl_head", F.lit(i)).alias(c) for i, c in enumerate(Header._fields, 1)),
    )
