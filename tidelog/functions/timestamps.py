"""Timestamp expressions (T1-T9): strict RFC 3339, RFC 2822, epochs, custom formats, the cascade, relative ages."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
# Conversion codes of custom formats and their letters here.
STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "z": "Z",
    "I": "hh", "p": "a", "j": "DDD", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm", "%": "%",
}


def rfc3339(text: Column) -> Column:
    """T1 (also ISO 8601): zone and colon in the offset are mandatory; else null."""
    return F.when(text.rlike(RFC3339), F.upper(text).try_cast("timestamp"))


def rfc2822(text: Column) -> Column:
    """The day name is optional."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"(?i)\s(?:GMT|UTC|UT|Z)$", " +0000")
    return F.when(
        bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    )


def unix_epoch(text: Column) -> Column:
    """10 to 13 digits; above 10^12 milliseconds, else seconds."""
    number = F.when(text.rlike(r"^\d{10,13}$"), text.try_cast("bigint"))
    return F.when(number > 1_000_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))


def epoch_seconds(number: Column) -> Column:
    """An integer counts as seconds; null beyond the years 1 to 9999."""
    return F.when(number.between(-62_135_596_800, 253_402_300_799), F.timestamp_seconds(number))


def java_format(strftime: str) -> str | None:
    """A strftime format in this engine's letters; None if a code has no counterpart."""
    out, i = [], 0
    while i < len(strftime):
        c = strftime[i]
        if c == "%":
            i += 1
            letters = STRFTIME.get(strftime[i : i + 1])
            if letters is None:
                return None
            out.append(letters)
        else:
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
        i += 1
    return "".join(out)


def custom(text: Column, formats: list[tuple[str, str]]) -> Column:
    """T4: (regex, strftime) pairs; the first regex that matches decides, even if parsing fails; bad ones are skipped."""
    out: Column | None = None
    for pattern, strftime in formats:
        try:
            re.compile(pattern)
        except re.error:
            continue
        letters = java_format(strftime)
        parsed = F.lit(None).cast("timestamp") if letters is None else F.try_to_timestamp(text, F.lit(letters))
        out = F.when(text.rlike(pattern), parsed) if out is None else out.when(text.rlike(pattern), parsed)
    return F.lit(None).cast("timestamp") if out is None else out


def parse_timestamp(text: Column, as_of: str | None = None, formats: list[tuple[str, str]] = ()) -> Column:
    """T5: RFC 3339, RFC 2822, epoch, custom formats, else ``as_of`` (null without it)."""
    t = F.trim(text)
    found = F.coalesce(rfc3339(t), rfc2822(t), unix_epoch(t), custom(t, list(formats)))
    if as_of is None:
        warnings.warn("without as_of, texts that no format fits give null", stacklevel=2)
        return found
    return F.coalesce(found, F.lit(as_of).cast("timestamp"))


def time_ago(ts: Column, as_of: Column) -> Column:
    """Whole seconds, minutes, hours or days before ``as_of``."""
    s = F.unix_seconds(as_of) - F.unix_seconds(ts)
    n = lambda unit: F.floor(s / unit).cast("string")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" seconds ago")))
        .when(s < 3600, F.concat(n(60), F.lit(" minutes ago")))
        .when(s < 86400, F.concat(n(3600), F.lit(" hours ago")))
        .otherwise(F.concat(n(86400), F.lit(" days ago")))
    )


def absolute(ts: Column) -> Column:
    """T7."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'")


def report_time(ts: Column, raw: Column) -> Column:
    """A null time falls back to the first two words of the raw line."""
    words = F.split(F.trim(raw), r"\s+")
    return F.coalesce(absolute(ts), F.when(F.size(words) >= 2, F.concat_ws(" ", F.slice(words, 1, 2))), F.lit("No timestamp"))


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and seconds, leading zero units left out."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    part = lambda x, u: F.concat(x.cast("string"), F.lit(u))
    return (
        F.when(h > 0, F.concat_ws(" ", part(h, "h"), part(m, "m"), part(s, "s")))
        .when(m > 0, F.concat_ws(" ", part(m, "m"), part(s, "s")))
        .otherwise(part(s, "s"))
    )
