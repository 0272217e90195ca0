"""Times of log records in many notations -> one UTC instant (problem 2).

One alternation of named groups covers every notation; each text is matched once and all components come
out of that single match.  Calendar ranges are checked on integers, the instant is assembled by integer day
arithmetic, and wall-clock times are resolved against the zone's offsets a day before and after, which tells
times that the zone skips or shows twice from ordinary ones.  Everything is a JVM expression.
"""

from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.lets import let
from tidelog.session import small_side

# Month names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Abbreviations that are certain without knowing the source's zone.
CERTAIN = ("UTC", "GMT", "Z")
#: Years whose zone abbreviations are known; where a meaning changed, the latest counts.
ABBREVIATION_YEARS = range(1990, 2038)

#: Names of the zone database that stand for no place; the JVM doesn't know them.
NO_ZONES = {"Factory", "localtime", "posixrules"}

_MON = "(?:" + "|".join(MONTHS) + ")"
_DAY = "(?:mon|tue|wed|thu|fri|sat|sun)"
_NUM_ZONE = r"[+-]\d{2}(?::?\d{2})?"
# Components in the order they are extracted; a notation names its group <component><letter of the notation>.
_PARTS = ("y", "mo", "mn", "d", "n1", "n2", "h", "mi", "s", "f", "ap", "z", "ep", "ef", "ia")
_NOTATIONS = {
    # 2024-10-15T02:49:19.551697Z, with comma or point, t and z, offsets of three forms, abbreviation or [zone]
    "a": r"(?<y>\d{4})-(?<mo>\d{1,2})-(?<d>\d{1,2})[T ](?<h>\d{1,2}):(?<mi>\d{2}):(?<s>\d{2})(?:[.,](?<f>\d+))?"
    rf"(?: ?(?<z>Z|{_NUM_ZONE}|[A-Z]{{2,5}}))?(?:\[(?<ia>[A-Z][A-Z0-9_+/-]*)\])?",
    # 20241016T022951Z
    "b": r"(?<y>\d{4})(?<mo>\d{2})(?<d>\d{2})T(?<h>\d{2})(?<mi>\d{2})(?<s>\d{2})(?:[.,](?<f>\d+))?"
    rf"(?<z>Z|{_NUM_ZONE})?",
    # 2024/10/15 11:35:47
    "c": r"(?<y>\d{4})/(?<mo>\d{1,2})/(?<d>\d{1,2}) (?<h>\d{1,2}):(?<mi>\d{2}):(?<s>\d{2})(?:[.,](?<f>\d+))?"
    rf"(?: ?(?<z>Z|{_NUM_ZONE}|[A-Z]{{2,5}}))?",
    # 17/10/2024 01:51:39, 11/10/2024 4:14:07 PM: day and month as the source orders them
    "e": r"(?<n1>\d{1,2})(?:/(?=\d+/)|-(?=\d+-))(?<n2>\d{1,2})[/-](?<y>\d{4}),? "
    r"(?<h>\d{1,2}):(?<mi>\d{2}):(?<s>\d{2})(?:[.,](?<f>\d+))?(?: ?(?<ap>[AP]M))?"
    rf"(?: (?<z>{_NUM_ZONE}|[A-Z]{{3,5}}))?",
    # 19.10.2024 23:48:01: with points the day stands first everywhere
    "f": r"(?<d>\d{1,2})\.(?<mo>\d{1,2})\.(?<y>\d{4}),? (?<h>\d{1,2}):(?<mi>\d{2}):(?<s>\d{2})(?:[.,](?<f>\d+))?"
    rf"(?: (?<z>{_NUM_ZONE}|[A-Z]{{3,5}}))?",
    # 14/Oct/2024:22:03:52 -0500
    "g": rf"(?<d>\d{{1,2}})/(?<mn>{_MON})/(?<y>\d{{4}}):(?<h>\d{{2}}):(?<mi>\d{{2}}):(?<s>\d{{2}})(?: (?<z>{_NUM_ZONE}))?",
    # Tue, 15 Oct 2024 21:48:31 +0200 and 15 Oct 2024 19:16:16,535
    "i": rf"(?:{_DAY}, )?(?<d>\d{{1,2}}) (?<mn>{_MON}) (?<y>\d{{4}}) (?<h>\d{{1,2}}):(?<mi>\d{{2}}):(?<s>\d{{2}})"
    rf"(?:[.,](?<f>\d+))?(?: ?(?<z>{_NUM_ZONE}|[A-Z]{{1,5}}))?",
    # Tue Oct 15 07:13:26 2024
    "k": rf"{_DAY} (?<mn>{_MON}) +(?<d>\d{{1,2}}) (?<h>\d{{1,2}}):(?<mi>\d{{2}}):(?<s>\d{{2}})(?: (?<z>[A-Z]{{3,5}}))? (?<y>\d{{4}})",
    # Oct 15 06:13:13
    "m": rf"(?<mn>{_MON}) +(?<d>\d{{1,2}}) (?<h>\d{{1,2}}):(?<mi>\d{{2}}):(?<s>\d{{2}})(?:[.,](?<f>\d+))?",
    # seconds, milliseconds, microseconds or nanoseconds since 1970
    "q": r"(?<ep>\d{19}|\d{16}|\d{13}|\d{9,10})(?:\.(?<ef>\d+))?",
}


def _compiled() -> tuple[str, str]:
    """The alternation with distinct group names, and the replacement that lists its components."""
    names: dict[str, list[str]] = {p: [] for p in _PARTS}
    branches = []
    for letter, body in _NOTATIONS.items():
        for p in sorted(_PARTS, key=len, reverse=True):
            if f"(?<{p}>" in body:
                body = body.replace(f"(?<{p}>", f"(?<{p}{letter}9>")
                names[p].append(f"{p}{letter}9")
        branches.append(body)
    # A group that didn't take part contributes nothing, hence the groups of one component can stand side by side.
    listed = "\u0002".join("".join(f"${{{n}}}" for n in names[p]) for p in _PARTS)
    return r"(?i)^\s*(?:" + "|".join(branches) + r")\s*$", "\u0001" + listed


ALTERNATION, _REPLACEMENT = _compiled()


def zone_table(sources: DataFrame) -> DataFrame:
    """(tz, abbrs MAP<STRING,INT>) of the zones that ``sources`` names: offsets in seconds by abbreviation.

    Only names of the zone database pass the filter, so at most its 600 or so reach the driver.  Numeric
    abbreviations are left out.
    """
    known = sources.select("tz").where(F.col("tz").isin(sorted(available_timezones() - NO_ZONES))).distinct()
    names, maps = [], []
    for (name,) in known.collect():
        zone, abbrs = ZoneInfo(name), {}
        for year in ABBREVIATION_YEARS:
            for month in (1, 7):
                at = datetime(year, month, 1, tzinfo=timezone.utc).astimezone(zone)
                if at.tzname().isalpha():
                    abbrs[at.tzname().upper()] = int(at.utcoffset().total_seconds())
        names.append(name)
        maps.append(list(abbrs.items()))
    kinds = pa.schema([("tz", pa.string()), ("abbrs", pa.map_(pa.string(), pa.int32()))])
    return sources.sparkSession.createDataFrame(pa.table({"tz": names, "abbrs": maps}, schema=kinds))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic (y >= 0)."""
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return era * 146097 + doe - 719468


def is_leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def time_text(ts_text: Column, raw: Column, fmt: Column) -> Column:
    """The time text of a record: ``ts_text``, or where that is null the time that stands in ``raw``."""
    head = F.substring_index(raw, "\n", 1)
    value = r'"\s*:\s*(?:"([^"]*)"|([\d.]+))'
    in_json = F.coalesce(
        *(
            F.nullif(F.concat(F.regexp_extract(raw, f'"{key}{value}', 1), F.regexp_extract(raw, f'"{key}{value}', 2)), F.lit(""))
            for key in ("timestamp", "time", "@timestamp")
        )
    )
    found = (
        F.when(fmt == "json", in_json)
        .when(fmt == "apache", F.regexp_extract(head, r"^\S+ \S+ \S+ \[([^\]]+)\]", 1))
        .when(fmt == "nginx", F.regexp_extract(head, r"^\s*(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})", 1))
        .when(
            fmt == "syslog",
            F.regexp_extract(head, r"^<\d+>(?:\d+\s+(?=\d{4}-))?([A-Za-z]{3}\s+\d{1,2}\s+[\d:.]+|\S+)", 1),
        )
        .otherwise(
            F.regexp_extract(
                head, r"^\s*(?:\[(?=.*\] [A-Za-z]+ ))?(.+?)(?:\] (?=[A-Za-z]+ )| {2,}(?=[A-Za-z]{3,}\b(?! +\d+ \d\d:)))", 1
            )
        )
    )
    return F.coalesce(ts_text, found)


def _offset_at(seconds: Column, tz: Column) -> Column:
    """Offset in seconds that ``tz`` has at a UTC instant."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(seconds), tz)) - seconds


def wall_to_seconds(wall: Column, tz: Column) -> Column:
    """The one UTC second at which clocks of ``tz`` show ``wall``; null if they skip it or show it twice."""

    def choose(o: Column) -> Column:
        fits_b, fits_a = _offset_at(wall - o["b"], tz) == o["b"], _offset_at(wall - o["a"], tz) == o["a"]
        return (
            F.when(o["a"] == o["b"], F.when(fits_b, wall - o["b"]))
            .when(fits_b & ~fits_a, wall - o["b"])
            .when(fits_a & ~fits_b, wall - o["a"])
        )

    return let(F.struct(_offset_at(wall - 86400, tz).alias("b"), _offset_at(wall + 86400, tz).alias("a")), choose)


def _fraction(digits: Column) -> Column:
    """Microseconds of the digits after the point; finer ones are cut off."""
    return F.coalesce(F.rpad(F.substring(digits, 1, 6), 6, "0").try_cast("bigint"), F.lit(0))


def _components(p: Column, order: Column, abbrs: Column) -> Column:
    """The matched groups as typed components."""
    part = {name: F.nullif(F.get(p, F.lit(i)), F.lit("")) for i, name in enumerate(_PARTS)}
    num = {name: part[name].try_cast("int") for name in ("y", "mo", "d", "n1", "n2", "h", "mi", "s")}
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part["mn"])).cast("int")
    dmy, mdy, zone = order == "dmy", order == "mdy", F.upper(part["z"])
    hour = F.when(part["ap"].isNull(), num["h"]).when(
        num["h"].between(1, 12), num["h"] % 12 + F.when(F.upper(part["ap"]) == "PM", 12).otherwise(0)
    )
    zone_min = F.coalesce(F.regexp_extract(zone, r"^[+-]\d\d:?(\d\d)$", 1).try_cast("int"), F.lit(0))
    numeric = F.substring(zone, 2, 2).try_cast("int") * 3600 + zone_min * 60
    meant = F.try_element_at(abbrs, zone)
    offset = (
        F.when(zone.startswith("-"), -numeric)
        .when(zone.startswith("+"), numeric)
        .otherwise(F.coalesce(meant, F.when(zone.isin(*CERTAIN), 0)))
    )
    return F.struct(
        num["y"].alias("y"),
        F.coalesce(num["mo"], month, F.when(dmy, num["n2"]).when(mdy, num["n1"])).alias("mo"),
        F.coalesce(num["d"], F.when(dmy, num["n1"]).when(mdy, num["n2"])).alias("d"),
        hour.alias("h"),
        num["mi"].alias("mi"),
        num["s"].alias("s"),
        _fraction(part["f"]).alias("us"),
        F.when((F.abs(offset) < 86400) & (zone_min < 60), offset).alias("offset"),
        zone.isNotNull().alias("zoned"),
        part["ia"].isNotNull().alias("named"),
        part["ep"].alias("epoch"),
        _fraction(part["ef"]).alias("epoch_us"),
    )


def _year(t: Column, arrived: Column) -> Column:
    """The year in the text, or the latest that puts the wall clock not after ``arrived`` (wall clock, too)."""
    place = lambda mo, d, h, mi, s, us: ((((mo * 32 + d) * 24 + h) * 60 + mi) * 60 + s).cast("bigint") * 1_000_000 + us
    later = place(*(t[x] for x in ("mo", "d", "h", "mi", "s", "us"))) > place(
        F.month(arrived), F.dayofmonth(arrived), F.hour(arrived), F.minute(arrived), F.second(arrived), F.pmod(F.unix_micros(arrived), F.lit(1_000_000))
    )

    def leap(y: Column) -> Column:
        back = y - y % 4
        back = F.when(is_leap(back), back).otherwise(back - 4)
        return F.when((t["mo"] == 2) & (t["d"] == 29) & ~is_leap(y), back).otherwise(y)

    return F.coalesce(t["y"], let(F.year(arrived) - F.when(later, 1).otherwise(0), leap))


def _wall(t: Column, year: Column) -> Column:
    """Seconds of the wall clock since 1970; null unless date and time exist in the calendar."""
    last = (
        F.when(t["mo"].isin(4, 6, 9, 11), 30).when((t["mo"] == 2) & is_leap(year), 29).when(t["mo"] == 2, 28).otherwise(31)
    )
    exists = (
        year.between(1, 9999) & t["mo"].between(1, 12) & t["d"].between(1, last) & t["h"].between(0, 23)
        & t["mi"].between(0, 59) & t["s"].between(0, 59)
    )
    seconds = days_from_civil(year, t["mo"], t["d"]) * 86400 + t["h"] * 3600 + t["mi"] * 60 + t["s"]
    return F.when(exists, seconds.cast("bigint"))


def _instant(t: Column, tz: Column, ingested_at: Column) -> Column:
    """Microseconds since 1970 UTC of the typed components, or null."""
    digits, whole = F.length(t["epoch"]), t["epoch"].try_cast("bigint")
    since = (
        F.when(digits == 19, F.floor(whole / 1000))
        .when(digits == 16, whole)
        .when(digits == 13, whole * 1000)
        .otherwise(whole * 1000000 + t["epoch_us"])
    )
    by_wall = let(
        _year(t, F.from_utc_timestamp(ingested_at, tz)),
        lambda y: let(
            _wall(t, y),
            lambda w: F.when(t["zoned"], w - t["offset"]).when(~t["named"], wall_to_seconds(w, tz)),
        ),
    )
    return F.when(t["epoch"].isNotNull(), since).otherwise(by_wall * 1000000 + t["us"]).cast("bigint")


def instant_us(text: Column, tz: Column, order: Column, abbrs: Column, ingested_at: Column) -> Column:
    """The instant of one time text; ``tz`` must be null or a zone of the zone database."""
    matched = F.regexp_replace(F.when(~text.rlike("[\u0001\u0002]"), text), ALTERNATION, _REPLACEMENT)
    return let(
        matched,
        lambda m: F.when(
            F.substring(m, 1, 1) == "\u0001",
            let(
                F.split(m.substr(F.lit(2), F.length(m)), "\u0002", -1),
                lambda p: let(_components(p, order, abbrs), lambda t: _instant(t, tz, ingested_at)),
            ),
        ),
    )


def with_source_facts(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """``entries`` with ``_tl_tz`` (null unless a known zone), ``_tl_order`` and ``_tl_abbrs`` of its source."""
    zones = zone_table(sources).select(F.col("tz").alias("_tl_tz"), F.col("abbrs").alias("_tl_abbrs"))
    facts = sources.select(
        F.col("source").alias("_tl_source"), F.col("tz").alias("_tl_named"), F.lower("date_order").alias("_tl_order")
    ).dropDuplicates(["_tl_source"])
    facts = facts.join(zones, F.col("_tl_named") == F.col("_tl_tz"), "left").drop("_tl_named")
    facts = small_side(facts)
    return entries.join(facts, entries["source"] == facts["_tl_source"], "left").drop("_tl_source")


def resolve_instants(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``epoch_us BIGINT``: the instant of each entry in microseconds since 1970, null where none is certain.

    ``entries``: source, format, ts_text, raw, ingested_at and any other columns, which stay; ``sources``:
    source, tz, date_order.  All rows stay.  Null, empty, impossible and unknown texts give null, and
    so do wall-clock times that the zone skips or shows twice, times without zone of a source without a known
    zone, and numeric dates of a source without date order.  A missing year is the latest that puts the instant
    not after ``ingested_at``; with null ``ingested_at`` there is none.  Working columns begin with ``_tl_``;
    an ``epoch_us`` that the input already has is replaced.
    """
    df = with_source_facts(entries, sources)
    text = time_text(F.col("ts_text"), F.col("raw"), F.col("format"))
    instant = instant_us(text, F.col("_tl_tz"), F.col("_tl_order"), F.col("_tl_abbrs"), F.col("ingested_at"))
    return df.withColumn("epoch_us", instant).drop("_tl_tz", "_tl_order", "_tl_abbrs")


def certain_instants(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(entry_id, epoch_us) of the entries with exactly one instant; the generator evaluates it once a row."""
    df = resolve_instants(entries.select("entry_id", "source", "format", "ts_text", "raw", "ingested_at"), sources)
    return df.select("entry_id", F.explode(F.array_compact(F.array("epoch_us"))).alias("epoch_us"))
