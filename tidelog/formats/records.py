"""Record parsers P1-P18: a DataFrame with ``line`` -> records.  Lines that don't match are left out.

Every parser keeps the columns of its input, except ``line``, and adds the record columns; clashing ones are
replaced.  Expressions only, no Python: a line is trimmed once and matched once, all groups come out of that match,
and a generator drops the lines that don't match without evaluating the record a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from contextvars import ContextVar
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import severity as sev
from tidelog.functions import timestamps as tm
from tidelog.functions.lets import let
from tidelog.functions.text import trim_unicode

# Line layouts.
APACHE_COMMON = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-)'
APACHE_COMBINED = APACHE_COMMON + r' "([^"]*)" "([^"]*)"'
NGINX_ACCESS = r'^(\S+) - - \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+) ([\d.]+)'
NGINX_ERROR = r"(?d)^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (\d+)#(\d+): (.+)"
SYSLOG_3164 = r"(?d)^<(\d+)>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:]+):\s*(.+)"
SYSLOG_5424 = r"(?d)^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:\[([^\]]+)\]\s+)?(.*)$"
PLAIN_TIME = r"(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
# Keys of JSON records, the first that is present counts.
JSON_MESSAGE, JSON_LEVEL, JSON_TIME = ("message", "msg", "text"), ("level", "severity", "priority"), ("timestamp", "time", "@timestamp")
JSON_CONSUMED = ("message", "msg", "text", "level", "severity", "timestamp", "time")

#: Columns of a record.
COLUMNS = ("ts", "severity", "message", "file", "file_line", "function", "thread", "extra", "raw")


def json_guard(t: Column) -> Column:
    """Strict JSON objects only; a lenient parser would accept trailing text."""
    return let(_wrapped(t), lambda v: F.coalesce(_is_one(t, v), F.lit(False)))


def _wrapped(t: Column) -> Column:
    """The text as the only element of a JSON array, which rejects anything after it."""
    return F.when(t.startswith("{") & t.endswith("}"), F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))))


def _is_one(t: Column, wrapped: Column) -> Column:
    second = F.try_variant_get(wrapped, "$[1]", "variant")
    return wrapped.isNotNull() & second.isNull()


def is_apache(line: Column) -> Column:
    """The combined layout begins with the common one, whose end is open."""
    return line.rlike(APACHE_COMMON)


def is_nginx(line: Column) -> Column:
    return line.rlike(NGINX_ACCESS) | line.rlike(NGINX_ERROR)


def is_syslog(line: Column) -> Column:
    return line.rlike(SYSLOG_5424) | line.rlike(SYSLOG_3164)


def is_json(line: Column) -> Column:
    return json_guard(trim_unicode(line))


#: The columns that are built at present.
_wanted: ContextVar[tuple[str, ...]] = ContextVar("wanted", default=COLUMNS)


def _extra(pairs: dict[str, Column]) -> Column:
    """A map without the keys whose value is null."""
    if "extra" not in _wanted.get():
        return F.lit(None).cast("map<string,string>")
    flat = [x for k, v in pairs.items() for x in (F.lit(k), v)]
    made = F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")
    return F.map_filter(made, lambda _, v: v.isNotNull())


def _unless_dash(c: Column) -> Column:
    return F.when(c != "-", c)


def _record(t: Column, **fields: Column) -> Column:
    """The struct of a record; metadata not given is null."""
    none, no_time, no_number = F.lit(None).cast("string"), F.lit(None).cast("timestamp"), F.lit(None).cast("bigint")
    defaults = {"ts": no_time, "file_line": no_number, "message": t, "extra": _extra({}), "raw": t}
    return F.struct(*(fields.get(c, defaults.get(c, none)).alias(c) for c in _wanted.get()))


def parse_with(df: DataFrame, build: Callable[[Column], Column], columns: tuple[str, ...] = COLUMNS, key: Hashable = None) -> DataFrame:
    """The records that ``build`` makes of the trimmed lines, without those of which it makes null.

    Only the named columns are built, as no optimiser prunes what a generator yields.  The expression is kept under
    ``key``, by default the function: to state it takes the client longer than to analyse it.
    """
    kept = [c for c in df.columns if c not in COLUMNS and c != "line"]
    record = _record_of(id(SparkContext._gateway), key or build, columns, build)
    df = df.select(*kept, F.explode(F.array_compact(F.array(record))).alias("_tl_r"))
    return df.select(*kept, *(F.col(f"_tl_r.{c}").alias(c) for c in columns))


class _Build:
    """A function that doesn't count in a cache's key."""

    def __init__(self, build: Callable[[Column], Column]):
        self.build = build

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Build)

    def __hash__(self) -> int:
        return 0


def _record_of(gateway: int, key: Hashable, columns: tuple[str, ...], build: Callable[[Column], Column]) -> Column:
    return _cached_record(gateway, key, columns, _Build(build))


@lru_cache(maxsize=64)
def _cached_record(gateway: int, key: Hashable, columns: tuple[str, ...], build: _Build) -> Column:
    token = _wanted.set(columns)
    try:
        return let(trim_unicode(F.col("line")), lambda t: F.when(t != "", build.build(t)))
    finally:
        _wanted.reset(token)


def _match(t: Column, pattern: str, groups: int, body: Callable[[Callable[[int], Column]], Column]) -> Column:
    """``body`` of the groups of one match of a pattern from the beginning of ``t``; null if there is none.

    Groups that took no part are ''.  A text that holds one of the two separators itself is matched group by group.
    """
    listed = "\u0001" + "\u0002".join(f"${i}" for i in range(1, groups + 1))
    whole = F.regexp_replace(t, pattern.removesuffix("$") + r"(?s:.*)\z", listed)
    at_once = let(whole, lambda x: F.when(x.startswith("\u0001"), F.split(x.substr(F.lit(2), F.length(x)), "\u0002", -1)))
    one_by_one = F.when(t.rlike(pattern), F.array(*(F.regexp_extract(t, pattern, i) for i in range(1, groups + 1))))
    parts = F.when(t.rlike("[\u0001\u0002]"), one_by_one).otherwise(at_once)
    return let(parts, lambda p: F.when(p.isNotNull(), body(lambda i: F.get(p, F.lit(i - 1)))))


def plain_record(t: Column) -> Column:
    """The whole line is the message; the first timestamp-like text must carry a zone."""
    stamp = F.regexp_replace(F.regexp_extract(t, PLAIN_TIME, 1), r"^(\S{10})\s", "$1T")
    return _record(t, ts=let(stamp, tm.rfc3339), severity=sev.plain_severity(t))


def parse_plain(df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    return parse_with(df, plain_record, columns)


def _json_fields(t: Column, wrapped: Column) -> Column:
    """The record of a JSON object, given as the only element of an array; keys are looked up one by one."""
    kind = lambda v: F.schema_of_variant(v)
    as_text = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    as_whole = lambda v: F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))

    def at(key: str) -> Column:
        """The value of a key; a JSON null is a value, too."""
        return F.try_variant_get(wrapped, f"$[0]['{key}']", "variant")

    def first(keys: tuple[str, ...], value: Callable[[Column], Column]) -> Column:
        """``value`` of the first key that is present."""
        return let(F.coalesce(*map(at, keys)), value)

    def strings() -> Column:
        """The strings that aren't fields of their own."""
        if "extra" not in _wanted.get():
            return _extra({})
        fields = F.try_variant_get(wrapped, "$[0]", "map<string,variant>")
        kept = F.map_filter(fields, lambda k, v: ~k.isin(*JSON_CONSUMED) & (kind(v) == "STRING"))
        return F.transform_values(kept, lambda _, v: F.try_variant_get(v, "$", "string"))

    def time_of(v: Column) -> Column:
        text = let(as_text(v), lambda x: F.coalesce(tm.rfc3339(x), tm.rfc2822(x)))
        return F.when(kind(v) == "STRING", text).otherwise(tm.epoch_seconds(as_whole(v)))

    text = lambda k: let(at(k), as_text)
    return _record(
        t,
        ts=first(JSON_TIME, time_of),
        severity=F.coalesce(first(JSON_LEVEL, lambda v: sev.json_severity(as_text(v))), F.lit("Unknown")),
        message=F.coalesce(first(JSON_MESSAGE, as_text), F.lit("")),
        file=text("file"),
        file_line=let(at("line"), lambda v: let(as_whole(v), lambda n: F.when(n >= 0, n.bitwiseAND(0xFFFFFFFF)))),
        function=F.coalesce(text("function"), text("func")),
        thread=F.coalesce(text("thread"), text("thread_id")),
        extra=strings(),
    )


def json_record(t: Column) -> Column:
    """P1-P3."""
    return let(_wrapped(t), lambda v: F.when(_is_one(t, v), _json_fields(t, v)))


def parse_json(df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    return parse_with(df, json_record, columns)


def clf_time(text: Column) -> Column:
    """10/Oct/2000:13:55:36 -0700; invalid is null."""
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def apache_record(t: Column) -> Column:
    """The combined layout, else the common one, in one pattern whose seventh group tells them apart."""

    def fields(g: Callable[[int], Column]) -> Column:
        status, combined = g(5).try_cast("int"), g(7) == " "
        extra = {
            "client_ip": g(1), "user": _unless_dash(g(2)), "status": status.cast("string"), "response_size": _unless_dash(g(6)),
            "referrer": F.when(combined, _unless_dash(g(8))), "user_agent": F.when(combined, _unless_dash(g(9))),
        }
        return _record(t, ts=clf_time(g(3)), severity=sev.http_severity(status), message=F.concat(status.cast("string"), F.lit(" "), g(4)), extra=_extra(extra))

    return _match(t, APACHE_COMMON + r'(?:( )"([^"]*)" "([^"]*)")?', 9, fields)


def parse_apache(df: DataFrame) -> DataFrame:
    return parse_with(df, apache_record)


def nginx_record(t: Column) -> Column:
    """Access lines, else error lines."""

    def access(t: Column, g: Callable[[int], Column]) -> Column:
        status = g(4).try_cast("int")
        extra = {"client_ip": g(1), "status": status.cast("string"), "response_size": g(5), "response_time": g(6)}
        return _record(t, ts=clf_time(g(2)), severity=sev.http_severity(status), message=F.concat(status.cast("string"), F.lit(" "), g(3)), extra=_extra(extra))

    def error(t: Column, g: Callable[[int], Column]) -> Column:
        at = F.try_to_timestamp(g(1), F.lit("yyyy/MM/dd HH:mm:ss"))
        return _record(t, ts=at, severity=sev.nginx_severity(g(2)), message=g(5), extra=_extra({"pid": g(3), "tid": g(4), "level": g(2)}))

    return F.coalesce(_match(t, NGINX_ACCESS, 6, lambda g: access(t, g)), _match(t, NGINX_ERROR, 5, lambda g: error(t, g)))


def parse_nginx(df: DataFrame) -> DataFrame:
    return parse_with(df, nginx_record)


def syslog_record(t: Column, year: int) -> Column:
    """RFC 5424, else RFC 3164, whose times get the given year."""

    def common(priority: Column, **extra: Column) -> dict[str, Column]:
        number = F.coalesce(F.when(priority <= 255, priority), F.lit(0))
        return {"severity": sev.syslog_severity(number), "extra": _extra({"priority": number.cast("string"), **extra})}

    def new(t: Column, g: Callable[[int], Column]) -> Column:
        parts = common(g(1).try_cast("bigint"), hostname=_unless_dash(g(4)), app_name=_unless_dash(g(5)), pid=_unless_dash(g(6)))
        return _record(t, ts=tm.rfc3339(g(3)), message=g(9), **parts)

    def old(t: Column, g: Callable[[int], Column]) -> Column:
        tag = g(4)
        bracketed = tag.contains("[") & tag.contains("]")
        pid = F.substring_index(F.substring_index(F.substring(tag, F.locate("[", tag) + 1, F.length(tag)), "]", 1), "[", -1)
        name = F.when(bracketed, F.substring_index(tag, "[", 1)).otherwise(tag)
        at = F.try_to_timestamp(F.concat(F.regexp_replace(g(2), r"\s+", " "), F.lit(f" {year}")), F.lit("MMM d HH:mm:ss yyyy"))
        return _record(t, ts=at, message=g(5), **common(g(1).try_cast("bigint"), hostname=g(3), app_name=name, pid=F.when(bracketed, pid)))

    return F.coalesce(_match(t, SYSLOG_5424, 9, lambda g: new(t, g)), _match(t, SYSLOG_3164, 5, lambda g: old(t, g)))


def parse_syslog(df: DataFrame, year: int) -> DataFrame:
    return parse_with(df, lambda t: syslog_record(t, year), key=("syslog", year))
