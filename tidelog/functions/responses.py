"""Texts from and for a language model: prompts H3, responses J1-J8, retries H7, H8."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.text import truncate_message
from tidelog.schema import ANALYSIS

ANALYSIS_TYPE = f"STRUCT<{ANALYSIS}>"
# Texts of errors that are worth another try, that aren't, and the replacements that repair JSON.
RETRYABLE = ("timeout", "timed out", "connection", "network", "429", "rate limit", "500", "502", "503", "empty response")
MALFORMED = ("json", "parse")
PERMANENT = ("401", "403", "400", "unauthorized", "forbidden", "authentication")
REPAIRS = (
    ("}\n{", "},\n{"), ("]\n[", "],\n["), ("}\n  {", "},\n  {"), ("]\n  [", "],\n  ["), ("}\n  ]", "}\n]"), ("]\n  ]", "]\n]"),
    (",\n}", "\n}"), (",\n]", "\n]"), (", }", " }"), (", ]", " ]"),
)
SHOWN = 200
NO_OBJECT = "no valid JSON object in response: "


def strip_fence(text: Column) -> Column:
    """The first fenced JSON block, else the first fenced block, else the trimmed text."""
    tagged, plain = r"(?s)```json\s*(.*?)```", r"(?s)```\s*(.*?)```"
    return F.trim(F.when(text.rlike(tagged), F.regexp_extract(text, tagged, 1)).when(text.rlike(plain), F.regexp_extract(text, plain, 1)).otherwise(text))


def balanced_object(text: str | None) -> str | None:
    """The first balanced object of a text; braces inside strings don't count."""
    if text is None or (start := text.find("{")) < 0:
        return None
    depth, inside, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if escaped:
            escaped = False
        elif inside and c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
        elif not inside and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def sanitize(text: str | None) -> str | None:
    """Control characters inside strings become escapes."""
    if text is None:
        return None
    out, inside, escaped = [], False, False
    for c in text:
        if inside and c < " ":
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, f"\\u{ord(c):04x}"))
            escaped = False
            continue
        if escaped:
            escaped = False
        elif inside and c == "\\":
            escaped = True
        elif c == '"':
            inside = not inside
        out.append(c)
    return "".join(out)


def repair(text: Column) -> Column:
    """Fixed replacements in order, inside strings as well."""
    for old, new in REPAIRS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


@F.pandas_udf(T.StringType())
def _object_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The only steps that built-in expressions can't state."""
    for s in texts:
        yield s.map(lambda t: sanitize(balanced_object(t)), na_action="ignore")


def is_valid(text: Column) -> Column:
    """An object with explanation and suggestions."""
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return F.coalesce(F.map_contains_key(parsed, F.lit("explanation")) & F.map_contains_key(parsed, F.lit("suggestions")), F.lit(False))


def extract_response(text: Column) -> Column:
    """STRUCT<json, error>: the object of a response, repaired; or why there is none."""
    found = repair(_object_of(strip_fence(text)))
    shown = F.concat(F.lit(NO_OBJECT), F.substring(F.coalesce(text, F.lit("")), 1, SHOWN))
    return F.when(is_valid(found), F.struct(found.alias("json"), F.lit(None).cast("string").alias("error"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("json"), shown.alias("error"))
    )


def typed_response(json_text: Column) -> Column:
    """The analysis; absent lists are null."""
    return F.from_json(json_text, ANALYSIS_TYPE)


def simple_response(text: Column) -> Column:
    """Fence stripped, then typed without repair; null unless every suggestion has description and priority."""
    parsed = F.from_json(strip_fence(text), ANALYSIS_TYPE)
    whole = F.forall(parsed["suggestions"], lambda x: x["description"].isNotNull() & x["priority"].isNotNull())
    return F.when(parsed["explanation"].isNotNull() & parsed["suggestions"].isNotNull() & whole, parsed)


def prompt(pattern: Column, count: Column, severity: Column, examples: Column, most: int = 3, longest: int = 2000) -> Column:
    """H3: pattern, count, severity and up to three examples, the pattern itself if there are none."""
    shown = F.when(F.size(examples) > 0, F.slice(examples, 1, most)).otherwise(F.array(pattern))
    shown = F.transform(shown, lambda x: truncate_message(x, longest))
    numbered = F.transform(shown, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.concat(
        F.lit("Analyze this error pattern from application logs.\n\nPattern: "), pattern,
        F.lit("\nOccurrences: "), count.cast("string"), F.lit("\nSeverity: "), severity,
        F.lit("\n\nExamples:\n"), F.array_join(numbered, "\n"),
        F.lit('\n\nAnswer with one JSON object with the keys "explanation", "root_cause" and "suggestions" (description, code_example, priority).'),
    )


def is_retryable(error: Column) -> Column:
    """H7: the lists are tried in order; what none knows is worth another try."""
    low = F.lower(error)
    return F.when(_any(low, RETRYABLE) | _any(low, MALFORMED), True).when(_any(low, PERMANENT), False).otherwise(True)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def backoff_ms(attempt: Column, initial_ms: int, max_ms: int) -> Column:
    """H8 without jitter: the initial delay doubled for each attempt, up to the most."""
    return F.least(F.lit(initial_ms) * F.pow(F.lit(2), attempt), F.lit(max_ms)).cast("bigint")


def jittered(delay_ms: int, rng: random.Random | None = None) -> int:
    """H8: the delay with up to a fifth more or less."""
    return max(0, round(delay_ms * (1 + (rng or random).uniform(-0.2, 0.2))))


class JsonText(NamedTuple):
    """J6 on the driver or inside a worker, for one response."""

    json: str | None
    error: str | None

    @classmethod
    def extract(cls, response: str) -> JsonText:
        text = response
        for fence in ("```json", "```"):
            start = response.find(fence)
            end = response.find("```", start + len(fence)) if start >= 0 else -1
            if end >= 0:
                text = response[start + len(fence) : end]
                break
        found = sanitize(balanced_object(text.strip()))
        for old, new in REPAIRS if found else ():
            found = found.replace(old, new)
        try:
            ok = found is not None and {"explanation", "suggestions"} <= json.loads(found).keys()
        except ValueError:
            ok = False
        return cls(found, None) if ok else cls(None, NO_OBJECT + response[:SHOWN])


def retry_worthy(error: str) -> bool:
    """H7 for one error."""
    low = error.lower()
    return any(w in low for w in RETRYABLE + MALFORMED) or not any(w in low for w in PERMANENT)
