"""String expressions: trimming, message patterns (N1), group ids (N2), HTML escaping (H1), truncation (H2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The branches of the message pattern, tried from first to last at each place.
PATTERN_BRANCHES = (
    r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    r"\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}",
    r"\d{2}\s+\w{3}\s+\d{4}\s+\d{2}:\d{2}:\d{2},\d{3}",
    r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    r"\b[A-Za-z0-9+/]{20,}={0,2}#\d+\b",
    r"\b\d{5,}\b",
    r"\b0x[0-9a-fA-F]+\b",
    r"\bWorker\d+\b",
    r"https?://[^\s]+",
    r"\b\d+\.\d+\.\d+\.\d+\b",
    r"/[\w/.-]+:\d+",
    r"\[[\w-]+-\d+\]",
    r"\bexec-\d+\b",
)
PLACEHOLDER = "<DYNAMIC>"
PATTERN = "|".join(PATTERN_BRANCHES)


#: The characters of Unicode white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_unicode(c: Column) -> Column:
    """Strip Unicode white space at both ends (the trim of all record parsers)."""
    return F.trim(c, F.lit(WHITE_SPACE))


def message_pattern(message: Column) -> Column:
    """Every variable part of a message becomes ``<DYNAMIC>``; null stays null.

    ASCII texts take the cheaper ASCII character classes, which agree with the Unicode ones there.
    """
    return F.when(message.rlike(r"[^\x00-\x7F]"), F.regexp_replace(message, "(?U)" + PATTERN, PLACEHOLDER)).otherwise(
        F.regexp_replace(message, PATTERN, PLACEHOLDER)
    )


def group_id(pattern: Column) -> Column:
    """A portable id of a pattern."""
    return F.concat(F.lit("err-"), F.substring(F.md5(pattern), 1, 16))


def html_escape(c: Column) -> Column:
    """H1: the five HTML special characters, ampersand first."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def truncate_message(c: Column, limit: int) -> Column:
    """H2: texts of more than ``limit`` bytes are cut after ``limit`` characters and marked; never inside one."""
    return F.when(F.octet_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("... (truncated)"))).otherwise(c)


def mask_api_key(c: Column) -> Column:
    """H4: values of ``api_key = "..."`` in configuration text become ``***``."""
    return F.regexp_replace(c, r'(api_key\s*=\s*")[^"]*(")', "$1***$2")


def contains_text(haystack: Column, needle: str) -> Column:
    """case-insensitive substring search, as the report's search box does."""
    return F.contains(F.lower(haystack), F.lit(needle.lower()))
