"""Data of persons in free text: found and replaced by typed placeholders (problem 4).

Method: anchor expansion.  One Aho-Corasick pass over the folded text (lower case, every digit 0) finds anchors:
at-signs and their disguises, schemes, number shapes, identifier cues, street words, known name parts and
words that introduce a person.  Deterministic local parsers expand each anchor and check its boundaries.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "name")

# Anchors in folded text, by the parser that expands them.
AT_SIGNS = ("@", "%40", "&#64;", "&#x40;", "&commat;", "\\u0040", "[at]", "(at)", "{at}", "<at>", " at ", "[@]", "(@)", "{@}", "＠")
PHONE_SHAPES = ("+0", "(000)", "(00000)", "000-000-0000", "000.000.0000", "000 000 0000", "0000-00-00", "00000 000 000", "00000 000000", "000 0000 0000", "00 00 00 00 00", "00.00.00.00.00", "tel:")
ID_CUES = (
    "ssn", "social security", "national id", "identity card", "id card", "personalausweis", "passport", "reisepass", "licence",
    "license", "führerschein", "tax number", "tax id", "tax no", "steuer-id", "steuernummer", "steuer id", "national insurance",
    "identity no", "insurance number", "000-00-0000",
)
STREET_CUES = (
    " street", " st", " avenue", " ave", " close", " lane", " road", " rd", " blvd", " boulevard", " terrace", " drive", " court",
    " crescent", " square", " place", " way", " rue ", "rue ", "p.o. box", "po box", "p.o.box", "postfach", "weg 0", "gasse 0",
    "straße 0", "strasse 0", "str. 0", "allee 0", "platz 0", "avenue de", "boulevard de", "calle ", "avenida ", "plaza ", "paseo ", "piazza ", "rua ",
)
PERSON_CUES = (
    "ms ", "mr ", "mrs ", "ms. ", "mr. ", "mrs. ", "dr. ", "prof. ", "herr ", "frau ", "mme ", "señor ", "señora ", "signor ", "name is ", "named ", "dear ",
    "customer ", "beneficiary ", "holder ", "patient ", "employee ", "contact ", "owner ", "tenant ", "attendee ", "recipient ", "applicant ", "client ",
    "customer\x02", "agent\x02", "owner\x02", "contact\x02", "name\x02", "customer\"", "agent\"", "name=",
    " by ", " for ", " to ", " with ",
)
# Prepositions that introduce a person only after a participle or a word of the second list.
PREPOSITIONS = (" by ", " for ", " to ", " with ")
GOES_TO_PERSONS = ("ticket", "copy", "letter", "invoice", "message", "call", "card", "parcel", "refund", "appointment", "account", "reminder")
# Words that stand in capitals next to names, or in the place of one, without being a part of it.
NOT_NAMES = frozenset(
    """the and for from has was with not new old reference relay gateway scheduler index service server client handler controller
    listener repository job worker queue pool lane order part token invoice session health probe build release account user
    ms mr mrs dr dear herr frau error warn info debug trace fatal critical cache heap clock lock plan quota login null
    asked rang moved your his her their our this that box port apt flat signed ticket customer beneficiary agent note
    support build bot system admin root team batch api web auth sync main""".split()
)

_FOLD = str.maketrans("123456789", "000000000")
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_LOCAL = r"[A-Za-z0-9!#$&'*+/=?^_`{|}~.-]"

#: Longest local part and domain of an address, the latter with room for its disguise.
MOST_LOCAL, MOST_DOMAIN = 64, 400
#: Characters on either side of a street word that an address can reach.
STREET_REACH = 120
_LABEL = r"[^\W_](?:(?:[^\W_]|-)*[^\W_])?"
_DOT = r"(?:\.|\s*[\[({]\s*(?i:dot|punkt|point)\s*[\])}]\s*)"
_LOCAL_END = re.compile(r"[^\W_][\w.!#$'*+~-]*$")
_DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])")
_SPOKEN = re.compile(rf"{_LABEL}(?: (?i:dot) {_LABEL})* (?i:dot) [A-Za-z]{{2,24}}(?![A-Za-z0-9])")

_NO_DIGIT_BEFORE, _NO_DIGIT_AFTER = r"(?<![\w.+/-])", r"(?![\w]|[.:/-]\w)"
_PHONES = [
    re.compile(_NO_DIGIT_BEFORE + body + _NO_DIGIT_AFTER)
    for body in (
        r"\+\d{1,3}(?:[ .-]?\(0?\d{1,4}\))?(?:[ ./-]?\d{1,5}){2,6}",
        r"\+\d{8,15}",
        r"00[1-9]\d{0,2}(?:[ ./-]\d{2,8}){2,5}",
        r"(?:1[ .-])?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}",
        r"(?:1[ .-])?\d{3}-\d{3}-\d{4}",
        r"(?:1[ .-])?\d{3}\.\d{3}\.\d{4}",
        r"(?<!\d )\d{3} \d{3} \d{4}",
        r"\(0\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}",
        r"0\d{4}[ -]\d{3}[ -]?\d{3}",
        r"0\d{2} \d{4} \d{4}",
        r"0[1-9](?:([ .])\d{2})(?:\1\d{2}){3}",
    )
]
_ID_VALUE = re.compile(
    r"(?:\s*(?:(?:no|nr|number|num|nummer|id|card|is)(?![A-Za-z0-9])\.?|[#:=\"'])){0,5}\s*"
    r"((?:[A-Z]{1,6}[ -]?)?\d(?:[ .\-/]?\d|[A-Z](?=\d|[^A-Z0-9]|$)){4,17}(?: (?-i:[A-Z])(?![A-Za-z0-9.]))?)(?![A-Za-z0-9])",
    re.IGNORECASE,
)
_SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w]|[.-]\w)")

_CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_SUFFIX = r"(?:street|st|avenue|ave|close|lane|road|rd|blvd|boulevard|terrace|drive|court|crescent|square|place|way)"
_TOWN = rf"(?:,? (?:\d{{4,5}} )?(?!is\b|and\b){_CAP}(?: {_CAP})?)?"
_STREETS = [
    re.compile(rx)
    for rx in (
        # Flat 8, 967 Millwheel St, Quarrytown / 459 Old Quarry Terrace, Apt 20
        rf"(?:\b(?i:flat|apt\.?|unit|suite) \d+, )?(?<![\w.:/-])\d{{1,5}}[A-Za-z]? {{1,3}}((?:{_CAP} {{1,3}}){{1,3}})(?i:{_SUFFIX})\b\.?"
        rf"(?:, (?i:apt|flat|unit|suite)\.? \d+)?(?:, {_CAP}(?: {_CAP})?)?",
        # 5 rue des Tilleuls, 20634 Port Salvere
        rf"(?<![\w.:/-])\d{{1,4}},? {{1,3}}((?i:rue|avenue|boulevard|place|chemin|calle) (?:(?i:de la|des|de|du|del|d') ?)?{_CAP}(?:[ -]{_CAP})*)"
        rf"(?:, \d{{4,5}} {_CAP}(?: {_CAP})?)?",
        # Birkenweg 58, 20199 Quarrytown
        rf"\b({_CAP}(?i:weg|gasse|straße|strasse|str\.|allee|platz)) {{1,3}}\d{{1,4}}[a-z]?\b(?:, \d{{4,5}} {_CAP}(?: {_CAP})?)?",
        # Calle Mayor 5, 28013 Madrid
        rf"\b((?i:calle|avenida|plaza|paseo|piazza|via|rua) (?:(?:de la|de|del|da|do|della) )?{_CAP}(?: {_CAP}){{0,3}}),? {{1,3}}\d{{1,4}}[a-z]?\b(?:, \d{{4,5}} {_CAP}(?: {_CAP})?)?",
        # P.O. Box 663, Neu-Brachen
        rf"\b((?i:p\.? ?o\.? ?box|postfach)) {{1,3}}\d+(?:, {_CAP}(?: {_CAP})?)?",
    )
]
_NAME_WORD = re.compile(_WORD)
_LEFT = re.compile(rf"({_WORD}|[^\W\d_])(\.?,? {{1,3}})$")
_RIGHT = re.compile(rf"(,? {{1,3}})(?:([^\W\d_])\.? {{1,3}})?({_WORD})")
_AFTER_CUE = re.compile(
    rf"(?:\s*[:=]?\s*\"?\s*)(?:(?i:ms|mr|mrs|dr|herr|frau|mme)\.? {{1,3}})?"
    rf"(?:({_CAP}),? {{1,3}}(?:[A-Z]\. {{1,3}})?({_CAP})|([A-Z])\. {{1,3}}({_CAP}))(?![\w-])"
)
_AFTER_QUERY = re.compile(rf"({_CAP})(?:\+|%20)(?:[A-Z]\.?(?:\+|%20))?({_CAP})(?![\w+%-])")
_WHOLE_NAME = re.compile(rf"\s*({_CAP}), ({_CAP})(?: [A-Z]\.?)?\s*")
_BEFORE_PREPOSITION = re.compile(rf"(?:[a-z]{{2,}}ed|sent|paid|{'|'.join(GOES_TO_PERSONS)})$", re.IGNORECASE)
_AFTER_CUE_LOW = re.compile(rf" {{0,3}}({_WORD}) {{1,3}}({_WORD})(?![\w-])")


def fold(text: str) -> str:
    """Lower case with every digit 0, of the same length."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_FOLD)


def parse_email(text: str, start: int, end: int, anchor: str) -> tuple[int, int] | None:
    """An address around an at-sign; null local parts, bare hosts and user parts of URLs are none."""
    spoken = anchor[0] in "[({< "
    low = max(0, start - MOST_LOCAL - 4)
    left, right = text[low:start], text[end : end + MOST_DOMAIN]
    if spoken and anchor != " at ":
        left, right = left.rstrip(), right.lstrip()
    elif "0" in anchor and text[start:end].lower() not in AT_SIGNS:
        return None
    local = _LOCAL_END.search(left)
    domain = (_SPOKEN if anchor == " at " else _DOMAIN).match(right)
    if not local or not domain or len(local.group()) > MOST_LOCAL:
        return None
    begin = low + local.start()
    if text[max(0, begin - 3) : begin] == "://" or (begin and text[begin - 1] == ":" and "://" in text[max(0, begin - 24) : begin]):
        return None
    skipped = len(text[end : end + MOST_DOMAIN]) - len(right)
    return begin, end + skipped + domain.end()


def parse_phone(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Numbers with 8 to 15 digits that begin within a few characters of a number shape."""
    low, out = max(0, start - 4), []
    window = text[max(0, low - 2) : end + 28]
    base = max(0, low - 2)
    for rx in _PHONES:
        for m in rx.finditer(window):
            digits = sum(c.isdigit() for c in m.group())
            if 8 <= digits <= 15 and m.start() + base <= end and m.end() + base >= start:
                out.append((m.start() + base, m.end() + base))
    return out


def parse_id(text: str, start: int, end: int, cue: str) -> tuple[int, int] | None:
    """The number after a cue, or one of a shape that needs none."""
    if cue == "000-00-0000":
        m = _SSN.match(text, start)
        return m.span() if m and "000" != m.group()[:3] else None
    if start and text[start - 1].isalnum():
        return None
    m = _ID_VALUE.match(text, end)
    if not m or sum(c.isdigit() for c in m.group(1)) < 5:
        return None
    return m.span(1)


def parse_address(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Postal addresses around a street word: house number and street, or a box."""
    base, out = max(0, start - STREET_REACH), []
    window = text[base : end + STREET_REACH]
    for rx in _STREETS:
        for m in rx.finditer(window):
            words = m.group(1).split()
            if any(w.lower() in ("of", "the", "in", "at", "to", "and") for w in words if len(words) > 1 and "rue" not in words[0].lower()):
                continue
            if m.start() + base <= end and m.end() + base >= start:
                out.append((m.start() + base, m.end() + base))
    return out


def _is_capital(word: str) -> bool:
    return word[:1].isupper() and word.lower() not in NOT_NAMES and not re.search(r"[a-z][A-Z]", word)


def _free(text: str, start: int, end: int) -> bool:
    """Whether [start, end) stands as words of its own, not inside a host, path, address or identifier."""
    before, after = text[start - 1 : start], text[end : end + 1]
    if before and (before.isalnum() or before in "._@%/\\-+#$") and not (before in "-" and text[start - 2 : start - 1] == " "):
        return False
    if after and (after.isalnum() or after in "_@%/\\-+#$"):
        return False
    return not (after == "." and text[end + 1 : end + 2].isalnum())


def parse_name(text: str, start: int, end: int, kinds: Callable[[str], set]) -> tuple[int, int] | None:
    """A full name, or an initial with a family name, around one known part."""
    if not _free(text, start, end):
        return None
    own = kinds(text[start:end])
    lower = text[start:end].islower()
    right = _RIGHT.match(text, end)
    if right and _free(text, right.start(3), right.end(3)):
        word, comma = right.group(3), right.group(1).startswith(",")
        other = kinds(word)
        fits = other and (other | own) >= {"given", "family"}
        if fits or (not other and not comma and "given" in own and _is_capital(word) and not lower and len(word) > 2):
            if not (comma and "family" not in own):
                return start, right.end(3)
        if comma and "family" in own and not other and _is_capital(word) and len(word) > 3 and not right.group(2):
            tail = text[right.end(3) : right.end(3) + 2]
            left = _LEFT.search(text[max(0, start - 40) : start])
            known_before = left and (kinds(left.group(1)) or len(left.group(1)) == 1)
            if not known_before and not tail[:1].isalnum() and (_introduced(text, start) or _quoted(text, start, right.end(3))):
                return start, right.end(3)
    left_text = text[max(0, start - 40) : start]
    left = _LEFT.search(left_text)
    if left:
        word, gap = left.group(1), left.group(2)
        begin = start - len(left.group(0))
        follows = right and right.group(1)[0] == " " and _is_capital(right.group(3)) and not kinds(right.group(3))
        if len(word) == 1 and "family" in own:
            if gap.startswith(".") and word.isalpha() and (word.isupper() or lower):
                if _free(text, begin, begin + 1) or not text[begin - 1 : begin].isalnum():
                    return begin, end
        elif gap.startswith(",") and "given" in own and _is_capital(word) and _free(text, begin, begin + len(word)):
            if _introduced(text, begin) or _quoted(text, begin, end):
                return begin, end
        elif not gap.strip() and "family" in own and _is_capital(word) and len(word) > 3 and not follows:
            if _free(text, begin, begin + len(word)):
                return begin, end
    return None


def _introduced(text: str, start: int) -> bool:
    """Whether a word that introduces a person stands before."""
    return fold(text[max(0, start - 16) : start]).rstrip(' ":').endswith(_CUE_ENDS)


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether [start, end) is all that stands between two quotes."""
    return text[start - 1 : start] == '"' == text[end : end + 1]


_CUE_ENDS = tuple(sorted({c.rstrip(' "\x02') for c in PERSON_CUES}))


def parse_introduced(text: str, start: int, end: int, cue: str) -> tuple[int, int] | None:
    """A name after a word that introduces a person."""
    if start and text[start - 1].isalnum() and cue not in PREPOSITIONS:
        return None
    if cue in PREPOSITIONS and not _BEFORE_PREPOSITION.search(text[max(0, start - 16) : start]):
        return None
    if cue == "name=":
        m = _AFTER_QUERY.match(text, end)
    elif cue == "name is ":
        m = _AFTER_CUE.match(text, end) or _AFTER_CUE_LOW.match(text, end)
    else:
        m = _AFTER_CUE.match(text, end)
    if not m:
        return None
    words = [w for w in m.groups() if w and len(w) > 1]
    if any(w.lower() in NOT_NAMES or re.search(r"[a-z][A-Z]", w) for w in words):
        return None
    if cue in (*PREPOSITIONS, "tenant ", "owner ", "client ") and any(w.isupper() for w in words):
        return None  # in a line of capitals every word looks like a name
    return min(m.start(i) for i in range(1, len(m.groups()) + 1) if m.group(i)), m.end()


class Finder:
    """The automaton and its parsers, for one list of known name parts."""

    def __init__(self, names: list[tuple[str, str]]):
        self.kinds: dict[str, set[str]] = {}
        for part, kind in names:
            self.kinds.setdefault(part.lower(), set()).add(kind)
        self.automaton = ahocorasick.Automaton()
        anchors: dict[str, list[tuple[str, str]]] = {}
        for kind, words in (("email", AT_SIGNS), ("phone", PHONE_SHAPES), ("id_number", ID_CUES), ("address", STREET_CUES), ("cue", PERSON_CUES), ("name", self.kinds)):
            for w in words:
                anchors.setdefault(fold(w), []).append((kind, fold(w)))
        for w, kinds in anchors.items():
            self.automaton.add_word(w, kinds)
        self.automaton.make_automaton()

    def known(self, word: str) -> set[str]:
        return self.kinds.get(word.lower(), _NONE)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of everything found; spans of one type may overlap."""
        out: set[tuple[int, int, str]] = set()
        emails: list[tuple[int, int]] = []
        later = []
        for last, kinds in self.automaton.iter(fold(text)):
            for kind, anchor in kinds:
                start, end = last + 1 - len(anchor), last + 1
                if kind == "email":
                    if hit := parse_email(text, start, end, anchor):
                        emails.append(hit)
                        out.add((*hit, "email"))
                elif kind == "phone":
                    out.update((*hit, "phone") for hit in parse_phone(text, start, end))
                elif kind == "id_number":
                    if hit := parse_id(text, start, end, anchor):
                        out.add((*hit, "id_number"))
                elif kind == "address":
                    if not text[end : end + 1].isalpha() or anchor[-1] in " 0":
                        out.update((*hit, "address") for hit in parse_address(text, start, end))
                else:
                    later.append((kind, start, end, anchor))
        for kind, start, end, anchor in later:
            hit = parse_name(text, start, end, self.known) if kind == "name" else parse_introduced(text, start, end, anchor)
            if hit and not any(a < hit[1] and hit[0] < b for a, b in emails):
                out.add((*hit, "name"))
        ids = [(a, b) for a, b, t in out if t == "id_number"]
        if ids:
            out = {x for x in out if x[2] != "phone" or not any(a < x[1] and x[0] < b for a, b in ids)}
        return sorted(out)

    def spans_of_value(self, key: str, value: str) -> list[tuple[int, int, str]]:
        """What is found in a value; its key is context only.  A value may be nothing but a name."""
        offset = len(key) + 1
        out = [(a - offset, z - offset, t) for a, z, t in self.spans(f"{key}{_VALUE_MARK}{value}") if a >= offset]
        whole = _WHOLE_NAME.fullmatch(value)
        if whole and (self.known(whole[1]) or self.known(whole[2])):
            out.append((whole.start(1), len(value.rstrip()), "name"))
        return out

    def redact(self, text: str, spans: list[tuple[int, int, str]] | None = None) -> str:
        """``text`` with ``<EMAIL>``, ``<PHONE>``, ``<ID_NUMBER>``, ``<ADDRESS>`` and ``<NAME>`` for what was found."""
        out, at = [], 0
        for start, end, kind in sorted(self.spans(text) if spans is None else spans, key=lambda x: (x[0], -x[1])):
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
                at = end
            elif end > at:
                at = end
        return "".join(out) + text[at:]


_NONE: set[str] = set()


@lru_cache(maxsize=4)
def finder(names: tuple[tuple[str, str], ...]) -> Finder:
    return Finder(list(names))


#: Most name parts that go to the workers; a longer list is an error, as nothing may be dropped silently.
MOST_NAME_PARTS = 1_000_000
_VALUE_MARK = "\x02"
FOUND = "entry_id BIGINT, field STRING, pii_type STRING"


def name_parts(names: DataFrame) -> tuple[tuple[str, str], ...]:
    """The list of known name parts, read to the driver under a bound on its size."""
    rows = names.where("name_part IS NOT NULL AND trim(name_part) <> ''").select("name_part", "name_kind").distinct().limit(MOST_NAME_PARTS + 1).collect()
    if len(rows) > MOST_NAME_PARTS:
        raise ValueError(f"more than {MOST_NAME_PARTS} name parts")
    return tuple(sorted((r[0].strip(), (r[1] or "").lower()) for r in rows))


def personal_data(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(entry_id, field, pii_type): one row for each entry, field and type found there at least once.

    ``entries``: entry_id, message, raw, extra MAP<STRING,STRING>; ``names``: name_part, name_kind; other columns
    are ignored.  Fields: 'message', 'raw', 'extra' (any value).  Null and empty texts hold nothing; repeated rows
    give repeated results; an empty list of names leaves the names that a word introduces.
    """
    parts = name_parts(names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(parts)
        for b in batches:
            ids, fields, types = [], [], []
            entry_ids = b["entry_id"].to_pylist()
            for field in ("message", "raw", "extra"):
                for entry_id, text in zip(entry_ids, b[field].to_pylist()):
                    if not text:
                        continue
                    found = {t for k, v in text if v for _, _, t in f.spans_of_value(k, v)} if field == "extra" else {t for _, _, t in f.spans(text)}
                    for t in sorted(found):
                        ids.append(entry_id)
                        fields.append(field)
                        types.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(types, pa.string())], names=["entry_id", "field", "pii_type"])

    return entries.select("entry_id", "message", "raw", "extra").mapInArrow(find, FOUND)


REDACTED = "entry_id BIGINT, message STRING, raw STRING, extra MAP<STRING,STRING>"


def redacted_entries(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(entry_id, message, raw, extra): the texts of each entry with a typed placeholder for each find; nulls stay."""
    parts = name_parts(names)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = finder(parts)
        for b in batches:
            texts = [pa.array([t and f.redact(t) for t in b[c].to_pylist()], pa.string()) for c in ("message", "raw")]
            extra = [
                None if m is None else [(k, v and f.redact(v, f.spans_of_value(k, v))) for k, v in m]
                for m in b["extra"].to_pylist()
            ]
            extra = pa.array(extra, pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([b["entry_id"], *texts, extra], names=["entry_id", "message", "raw", "extra"])

    return entries.select("entry_id", "message", "raw", "extra").mapInArrow(replace, REDACTED)
