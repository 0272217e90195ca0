"""Queries over the operators and the DuckDB statements that check them.

Log lines are made from ``events`` by one SQL text per template, of which only the time formats differ between the
two engines.  Times leave as microseconds, maps as single columns, so that both sides have the same types.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.formats import records
from tidelog.functions import severity as sev
from tidelog.functions import text as tx
from tidelog.functions import timestamps as tm
from tidelog.functions.responses import backoff_ms, extract_response, is_retryable, prompt, simple_response, typed_response
from tidelog.operators import cache as ca
from tidelog.operators import grouping as gr
from tidelog.operators import metadata as md
from tidelog.operators import stats as st
from tidelog.operators.detect import confidence_of, detect_from_samples, format_of
from tidelog.operators.enrich import MockProvider, enrich
from tidelog.operators.stitch import stitch
from tidelog.plans.pipeline import investigate
from tidelog.session import prepare, shared_dir, spread, table
from tidelog.sources.lines import read_lines, union_sources
from tidelog.streaming.watch import pattern_counts

AS_OF = "2024-06-01 00:00:00"
AS_OF_US = int(datetime(2024, 6, 1, tzinfo=timezone.utc).timestamp() * 1_000_000)
YEAR = 2024

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- templates ---------------------------------------------------------------------------------------------------

_TIMES = {
    "spark": {
        "iso": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS\")", "clf": "date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')",
        "slash": "date_format(ts, 'yyyy/MM/dd HH:mm:ss')", "mon": "date_format(ts, 'MMM')", "clock": "date_format(ts, 'HH:mm:ss')",
        "us": "unix_micros(cast(ts as timestamp))", "mail": "date_format(ts, 'dd MMM yyyy HH:mm:ss')", "comma": "date_format(ts, 'dd MMM yyyy HH:mm:ss,SSS')",
    },
    "duck": {
        "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')", "clf": "strftime(ts, '%d/%b/%Y:%H:%M:%S')",
        "slash": "strftime(ts, '%Y/%m/%d %H:%M:%S')", "mon": "strftime(ts, '%b')", "clock": "strftime(ts, '%H:%M:%S')",
        "us": "epoch_us(ts)", "mail": "strftime(ts, '%d %b %Y %H:%M:%S')", "comma": "strftime(ts, '%d %b %Y %H:%M:%S,%g')",
    },
}
_LVL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END"
_V = "CAST(CAST(floor(value * 100) AS BIGINT) AS STRING)"
_ID = "CAST(event_id AS STRING)"
_USER = "CAST(user_id AS STRING)"
_LONG = "lpad(CAST(event_id AS STRING), 7, '9')"
_UUID = "lpad(CAST(event_id AS STRING), 8, '0') || '-00aa-11bb-22cc-' || lpad(CAST(user_id AS STRING), 12, '0')"
_MSG = f"event_type || ' request ' || {_LONG} || ' of user ' || {_USER} || ' failed at /srv/app/main.go:' || {_USER} || ' in ' || {_V} || ' ms'"
_STATUS = "CAST(CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 301 END AS STRING)"

_TEMPLATES = {
    "plain": f"{{iso}} || CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '' ELSE '+0200' END || ' ' || {_LVL} || ' ' || {_MSG}",
    "plain_z": f"{{iso}} || 'Z ' || {_LVL} || ' ' || event_type || ' failed for user ' || {_LONG}",
    "json": (
        f"'{{{{\"' || CASE event_id % 3 WHEN 0 THEN 'message' WHEN 1 THEN 'msg' ELSE 'text' END || '\":\"' || {_MSG} || '\",\"level\":' || "
        f"CASE WHEN event_id % 7 = 0 THEN '3' ELSE '\"' || lower({_LVL}) || '\"' END || ',\"timestamp\":' || "
        f"CASE WHEN event_id % 5 = 0 THEN CAST({{us}} // 1000000 AS STRING) WHEN event_id % 5 = 1 THEN '\"' || {{mail}} || ' +0000\"' ELSE '\"' || {{iso}} || 'Z\"' END || "
        f"',\"line\":' || {_USER} || ',\"func\":\"run' || {_USER} || '\",\"thread\":\"t-' || {_USER} || '\"}}}}' || CASE WHEN event_id % 11 = 0 THEN ' x' ELSE '' END"
    ),
    "apache_common": f"'10.0.0.' || CAST(user_id % 256 AS STRING) || ' - ' || CASE WHEN event_id % 3 = 0 THEN '-' ELSE 'u' || {_USER} END || ' [' || {{clf}} || ' +0000] \"GET /' || event_type || '/' || {_ID} || ' HTTP/1.1\" ' || {_STATUS} || ' ' || CASE WHEN event_id % 5 = 0 THEN '-' ELSE {_V} END",
    "nginx_error": f"{{slash}} || ' [' || CASE event_id % 4 WHEN 0 THEN 'crit' WHEN 1 THEN 'warn' WHEN 2 THEN 'notice' ELSE 'debug' END || '] ' || {_USER} || '#' || {_ID} || ': *' || {_ID} || ' ' || event_type || ' failed, client: 10.1.2.' || CAST(user_id % 256 AS STRING)",
    "syslog_3164": f"'<' || CAST(event_id % 192 AS STRING) || '>' || {{mon}} || ' ' || lpad(CAST(day(ts) AS STRING), 2, ' ') || ' ' || {{clock}} || ' host' || {_USER} || ' app' || CASE WHEN event_id % 2 = 0 THEN '[' || {_ID} || ']' ELSE '' END || ': ' || event_type || ' value ' || {_V}",
    "syslog_5424": f"'<' || CAST(event_id % 300 AS STRING) || '>1 ' || {{iso}} || 'Z host' || {_USER} || ' ' || CASE WHEN event_id % 3 = 0 THEN '-' ELSE 'app' END || ' ' || {_ID} || ' ID1 ' || CASE WHEN event_id % 2 = 0 THEN '[a b=\"c\"] ' ELSE '- ' END || event_type || ' value ' || {_V}",
    "norm": (
        f"'m' || CAST(event_id % 13 AS STRING) || ' ' || CASE event_id % 13 WHEN 0 THEN {{iso}} || 'Z' WHEN 1 THEN {{slash}} WHEN 2 THEN {{comma}} WHEN 3 THEN {_UUID} "
        f"WHEN 4 THEN 'AAAAAAAAAABBBBBBBBBBCC==#' || {_ID} WHEN 5 THEN {_LONG} WHEN 6 THEN '0xfe' || {_ID} WHEN 7 THEN 'Worker' || {_ID} WHEN 8 THEN 'https://h.example/' || {_ID} || '?q=1' "
        f"WHEN 9 THEN '10.2.3.' || {_ID} WHEN 10 THEN '/srv/a-b/c.d:' || {_ID} WHEN 11 THEN '[pool-' || {_ID} || ']' ELSE 'exec-' || {_ID} END || ' end'"
    ),
    "meta": (
        f"CASE event_id % 5 WHEN 0 THEN '[worker-' || {_USER} || '] ' WHEN 1 THEN 'thread_id=' || {_USER} || ' ' ELSE '' END || 'request_id=' || {_ID} || ' at com.App.run' || {_USER} || '(App.java:' || {_V} || ') ' || "
        f"CASE WHEN event_id % 2 = 0 THEN 'tenant=' || event_type ELSE '' END"
    ),
    "trace": f"'Error: ' || event_type || chr(10) || CASE WHEN event_id % 3 = 0 THEN '  at run (native)' || chr(10) ELSE '' END || CASE WHEN event_id % 4 = 0 THEN '' ELSE '\tat a.B.c' || {_USER} || '(File' || {_USER} || '.java:' || {_ID} || ')' END",
    "times": (
        f"CASE event_id % 6 WHEN 0 THEN {{iso}} || 'Z' WHEN 1 THEN 'Mon, ' || {{mail}} || ' +0000' WHEN 2 THEN CAST({{us}} // 1000 AS STRING) WHEN 3 THEN CAST({{us}} // 1000000 AS STRING) "
        f"WHEN 4 THEN {{slash}} ELSE 'no time ' || {_ID} END"
    ),
    "stitch": (
        f"CASE event_id % 7 WHEN 0 THEN 'ERROR boom ' || {_ID} WHEN 1 THEN '\tat a.B.c(D.java:' || {_ID} || ')' WHEN 2 THEN '  continued ' || {_ID} WHEN 3 THEN 'INFO ok ' || {_ID} "
        f"WHEN 4 THEN '' WHEN 5 THEN 'Caused by: x' || {_ID} ELSE 'goroutine ' || {_ID} || ' [running]' END"
    ),
}
_TEMPLATES["apache_combined"] = _TEMPLATES["apache_common"] + f" || ' \"' || CASE WHEN event_id % 7 = 0 THEN '-' ELSE 'https://r.example/' || {_USER} END || '\" \"agent/' || {_USER} || '\"'"
_TEMPLATES["nginx_access"] = f"'10.0.0.' || CAST(user_id % 256 AS STRING) || ' - - [' || {{clf}} || ' +0000] \"GET /' || event_type || ' HTTP/1.1\" ' || {_STATUS} || ' ' || {_V} || ' 0.' || {_USER}"
_TEMPLATES["mixed"] = "CASE event_id % 6 " + " ".join(
    f"WHEN {i} THEN {_TEMPLATES[t]}" for i, t in enumerate(("json", "apache_common", "nginx_error", "syslog_3164", "plain_z"))
) + f" ELSE {_TEMPLATES['nginx_access']} END"


def line_sql(template: str, dialect: str) -> str:
    """The SQL text that makes a line of an event."""
    sql = _TEMPLATES[template].format(**_TIMES[dialect])
    if dialect == "spark":
        sql = sql.replace(" // ", " div ").replace("'\t", "'\\t")
    return sql


def lines(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """events with ``line`` by a template."""
    prepare(spark)
    return spread(table(spark, sf_dir, "events")).withColumn("line", F.expr(line_sql(template, "spark")))


def duck_lines(template: str) -> str:
    """The same for DuckDB, as a common table expression named l."""
    return f"l AS (SELECT *, {line_sql(template, 'duck')} AS line FROM events)"


def query(name: str, sql: str | None = None):
    """Register a query, and its check."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def us(c: Column) -> Column:
    return F.unix_micros(c)


# --- record parsers ------------------------------------------------------------------------------------------------

_SEV_WORD = "upper(regexp_extract({0}, '(?i)\\b(ERROR|ERR|FATAL|CRITICAL|WARN|WARNING|INFO|DEBUG|TRACE)\\b', 1))"
_SEV_CASE = (
    "CASE WHEN {0} IN ('ERROR','ERR','FATAL','CRITICAL') THEN 'Error' WHEN {0} IN ('WARN','WARNING') THEN 'Warning' "
    "WHEN {0} IN ('INFO','INFORMATION') THEN 'Info' WHEN {0} = 'DEBUG' THEN 'Debug' WHEN {0} = 'TRACE' THEN 'Trace' ELSE 'Unknown' END"
)
_PLAIN_SEV = _SEV_CASE.format(_SEV_WORD.format("line"))
# The layouts of times and lines, stated again for the checks.
_STRICT = r"'^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$'"
_PLAIN_TS = rf"regexp_extract(line, '(\d{{4}}-\d{{2}}-\d{{2}}[T\s]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?)', 1)"


def _duck_rfc3339(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {_STRICT}) THEN epoch_us(TRY_CAST({x} AS TIMESTAMPTZ)) END"


@query("parse_plain", f"WITH {duck_lines('plain')} SELECT event_id, {_duck_rfc3339(_PLAIN_TS)} AS ts_us, {_PLAIN_SEV} AS severity, line AS message FROM l")
def parse_plain(spark, sf_dir):
    return records.parse_plain(lines(spark, sf_dir, "plain").select("event_id", "line")).select("event_id", us(F.col("ts")).alias("ts_us"), "severity", "message")


_JTS = "json_extract_string(line, '$.timestamp')"


@query(
    "parse_json",
    f"""WITH {duck_lines('json')}
    SELECT event_id,
      CASE WHEN json_type(line, '$.timestamp') IN ('UBIGINT', 'BIGINT') THEN CAST({_JTS} AS BIGINT) * 1000000
           WHEN {_JTS} LIKE '%+0000' THEN epoch_us(strptime({_JTS}, '%d %b %Y %H:%M:%S +0000')) ELSE {_duck_rfc3339(_JTS)} END AS ts_us,
      CASE WHEN json_type(line, '$.level') = 'VARCHAR' THEN {_SEV_CASE.format("upper(json_extract_string(line, '$.level'))")} ELSE 'Unknown' END AS severity,
      coalesce(json_extract_string(line, '$.message'), json_extract_string(line, '$.msg'), json_extract_string(line, '$.text')) AS message,
      CAST(json_extract_string(line, '$.line') AS BIGINT) AS file_line, json_extract_string(line, '$.func') AS function,
      json_extract_string(line, '$.thread') AS thread
    FROM l WHERE json_valid(line)""",
)
def parse_json(spark, sf_dir):
    df = records.parse_json(lines(spark, sf_dir, "json").select("event_id", "line"))
    return df.select("event_id", us(F.col("ts")).alias("ts_us"), "severity", "message", "file_line", "function", "thread")


# Line layouts, stated again for the checks; those of the other formats below, too.
_AP = r"'^(\S+) \S+ (\S+) \[([^\]]+)\] \"([^\"]*)\" (\d{3}) (\d+|-)'".replace('\\"', '"')
_AC = _AP[:-1] + " \"([^\"]*)\" \"([^\"]*)\"'"
_HTTP = "CASE WHEN {0} BETWEEN 500 AND 599 THEN 'Error' WHEN {0} BETWEEN 400 AND 499 THEN 'Warning' ELSE 'Info' END"


def _g(pattern: str, i: int) -> str:
    return f"regexp_extract(line, {pattern}, {i})"


_CLF = "epoch_us(try_strptime({0}, '%d/%b/%Y:%H:%M:%S +0000'))"
_APACHE_COLUMNS = (
    f"event_id, {_CLF.format(_g(_AP, 3))} AS ts_us, {_HTTP.format('CAST(' + _g(_AP, 5) + ' AS INT)')} AS severity, "
    f"{_g(_AP, 5)} || ' ' || {_g(_AP, 4)} AS message, {_g(_AP, 1)} AS client_ip, nullif({_g(_AP, 2)}, '-') AS user_name, {_g(_AP, 5)} AS status, nullif({_g(_AP, 6)}, '-') AS response_size"
)


def _apache(spark, sf_dir, template, *more):
    df = records.parse_apache(lines(spark, sf_dir, template).select("event_id", "line"))
    x = lambda k: F.try_element_at("extra", F.lit(k))
    return df.select(
        "event_id", us(F.col("ts")).alias("ts_us"), "severity", "message", x("client_ip").alias("client_ip"), x("user").alias("user_name"),
        x("status").alias("status"), x("response_size").alias("response_size"), *(x(k).alias(k) for k in more),
    )


@query("parse_apache_common", f"WITH {duck_lines('apache_common')} SELECT {_APACHE_COLUMNS} FROM l")
def parse_apache_common(spark, sf_dir):
    return _apache(spark, sf_dir, "apache_common")


@query("parse_apache_combined", f"WITH {duck_lines('apache_combined')} SELECT {_APACHE_COLUMNS}, nullif({_g(_AC, 7)}, '-') AS referrer, nullif({_g(_AC, 8)}, '-') AS user_agent FROM l")
def parse_apache_combined(spark, sf_dir):
    return _apache(spark, sf_dir, "apache_combined", "referrer", "user_agent")


_NA = r"'^(\S+) - - \[([^\]]+)\] " + '"([^"]*)"' + r" (\d{3}) (\d+) ([\d.]+)'"
_NE = r"'^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (\d+)#(\d+): (.+)'"


@query(
    "parse_nginx_access",
    f"WITH {duck_lines('nginx_access')} SELECT event_id, {_CLF.format(_g(_NA, 2))} AS ts_us, {_HTTP.format('CAST(' + _g(_NA, 4) + ' AS INT)')} AS severity, "
    f"{_g(_NA, 4)} || ' ' || {_g(_NA, 3)} AS message, {_g(_NA, 5)} AS response_size, {_g(_NA, 6)} AS response_time FROM l",
)
def parse_nginx_access(spark, sf_dir):
    df = records.parse_nginx(lines(spark, sf_dir, "nginx_access").select("event_id", "line"))
    x = lambda k: F.try_element_at("extra", F.lit(k)).alias(k)
    return df.select("event_id", us(F.col("ts")).alias("ts_us"), "severity", "message", x("response_size"), x("response_time"))


@query(
    "parse_nginx_error",
    f"WITH {duck_lines('nginx_error')} SELECT event_id, epoch_us(try_strptime({_g(_NE, 1)}, '%Y/%m/%d %H:%M:%S')) AS ts_us, "
    f"CASE {_g(_NE, 2)} WHEN 'crit' THEN 'Error' WHEN 'warn' THEN 'Warning' WHEN 'notice' THEN 'Info' WHEN 'debug' THEN 'Debug' END AS severity, "
    f"{_g(_NE, 5)} AS message, {_g(_NE, 3)} AS pid, {_g(_NE, 4)} AS tid, {_g(_NE, 2)} AS level FROM l",
)
def parse_nginx_error(spark, sf_dir):
    df = records.parse_nginx(lines(spark, sf_dir, "nginx_error").select("event_id", "line"))
    x = lambda k: F.try_element_at("extra", F.lit(k)).alias(k)
    return df.select("event_id", us(F.col("ts")).alias("ts_us"), "severity", "message", x("pid"), x("tid"), x("level"))


_S3 = r"'^<(\d+)>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:]+):\s*(.+)'"
_S5 = r"'^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:\[([^\]]+)\]\s+)?(.*)$'"
_PRI = "CASE WHEN p <= 255 THEN p ELSE 0 END"
_PRI_SEV = f"CASE WHEN ({_PRI}) & 7 <= 3 THEN 'Error' WHEN ({_PRI}) & 7 = 4 THEN 'Warning' WHEN ({_PRI}) & 7 <= 6 THEN 'Info' ELSE 'Debug' END"


def _syslog(spark, sf_dir, template):
    df = records.parse_syslog(lines(spark, sf_dir, template).select("event_id", "line"), YEAR)
    x = lambda k: F.try_element_at("extra", F.lit(k)).alias(k)
    return df.select("event_id", us(F.col("ts")).alias("ts_us"), "severity", "message", x("priority"), x("hostname"), x("app_name"), x("pid"))


@query(
    "parse_syslog_3164",
    f"WITH {duck_lines('syslog_3164')}, q AS (SELECT *, CAST({_g(_S3, 1)} AS INT) AS p, {_g(_S3, 4)} AS tag FROM l) SELECT event_id, "
    rf"epoch_us(try_strptime(regexp_replace({_g(_S3, 2)}, '\s+', ' ', 'g') || ' {YEAR}', '%b %d %H:%M:%S %Y')) AS ts_us, {_PRI_SEV} AS severity, {_g(_S3, 5)} AS message, "
    f"CAST({_PRI} AS VARCHAR) AS priority, {_g(_S3, 3)} AS hostname, split_part(tag, '[', 1) AS app_name, nullif(regexp_extract(tag, '\\[(.*)\\]', 1), '') AS pid FROM q",
)
def parse_syslog_3164(spark, sf_dir):
    return _syslog(spark, sf_dir, "syslog_3164")


@query(
    "parse_syslog_5424",
    f"WITH {duck_lines('syslog_5424')}, q AS (SELECT *, CAST({_g(_S5, 1)} AS INT) AS p FROM l) SELECT event_id, {_duck_rfc3339(_g(_S5, 3))} AS ts_us, {_PRI_SEV} AS severity, "
    f"{_g(_S5, 9)} AS message, CAST({_PRI} AS VARCHAR) AS priority, nullif({_g(_S5, 4)}, '-') AS hostname, nullif({_g(_S5, 5)}, '-') AS app_name, nullif({_g(_S5, 6)}, '-') AS pid FROM q",
)
def parse_syslog_5424(spark, sf_dir):
    return _syslog(spark, sf_dir, "syslog_5424")


# --- detection ---------------------------------------------------------------------------------------------------

_IS = {
    "json": "(line LIKE '{%' AND line LIKE '%}' AND json_valid(line))",
    "apache": f"regexp_matches(line, {_AP})",
    "nginx": f"(regexp_matches(line, {_NA}) OR regexp_matches(line, {_NE}))",
    "syslog": f"(regexp_matches(line, {_S5}) OR regexp_matches(line, {_S3}))",
}
_FORMAT = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _IS.items()) + " ELSE 'plain' END"
_CONF = "CASE f WHEN 'json' THEN 0.95 WHEN 'apache' THEN 0.9 WHEN 'nginx' THEN 0.9 WHEN 'syslog' THEN 0.85 ELSE 0.5 END"


@query("detect_format", f"WITH {duck_lines('mixed')} SELECT event_id, {_FORMAT} AS format FROM l")
def detect_format(spark, sf_dir):
    return lines(spark, sf_dir, "mixed").select("event_id", format_of(F.col("line")).alias("format"))


@query("detect_confidence", f"WITH {duck_lines('mixed')}, q AS (SELECT event_id, {_FORMAT} AS f FROM l) SELECT f AS format, CAST({_CONF} AS DOUBLE) AS confidence, count(*) AS n FROM q GROUP BY 1, 2")
def detect_confidence(spark, sf_dir):
    df = lines(spark, sf_dir, "mixed").select(format_of(F.col("line")).alias("format"))
    return df.withColumn("confidence", confidence_of(F.col("format"))).groupBy("format", "confidence").agg(F.count("*").alias("n"))


@query(
    "detect_from_samples",
    f"WITH {duck_lines('mixed')}, c AS (SELECT CAST(user_id AS VARCHAR) AS source, " + ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS {n}" for n, c in _IS.items())
    + " FROM l GROUP BY 1) SELECT source, CASE WHEN greatest(json, apache, nginx, syslog) = 0 THEN 'plain' WHEN json = greatest(json, apache, nginx, syslog) THEN 'json' "
    "WHEN apache = greatest(json, apache, nginx, syslog) THEN 'apache' WHEN nginx = greatest(json, apache, nginx, syslog) THEN 'nginx' ELSE 'syslog' END AS format FROM c",
)
def detect_samples(spark, sf_dir):
    return detect_from_samples(lines(spark, sf_dir, "mixed").select(F.col("user_id").cast("string").alias("source"), "line"))


@query(
    "raw_file_formats",
    "WITH r AS (SELECT CAST(file_id AS VARCHAR) AS source, trim(raw, chr(9) || chr(10) || chr(13) || ' ') AS t, raw AS line FROM raw_lines WHERE raw IS NOT NULL), c AS (SELECT source, "
    + ", ".join(f"sum(CASE WHEN {c.replace('line', 't') if n == 'json' else c} THEN 1 ELSE 0 END) AS {n}" for n, c in _IS.items())
    + " FROM r GROUP BY 1) SELECT source, CASE WHEN greatest(json, apache, nginx, syslog) = 0 THEN 'plain' WHEN json = greatest(json, apache, nginx, syslog) THEN 'json' "
    "WHEN apache = greatest(json, apache, nginx, syslog) THEN 'apache' WHEN nginx = greatest(json, apache, nginx, syslog) THEN 'nginx' ELSE 'syslog' END AS format FROM c",
)
def raw_file_formats(spark, sf_dir):
    prepare(spark)
    raw = table(spark, sf_dir, "raw_lines").select(F.col("file_id").cast("string").alias("source"), F.col("raw").alias("line"))
    return detect_from_samples(raw.where("line IS NOT NULL"))


# --- severities, patterns, scalar functions -------------------------------------------------------------------------


@query("severity_counts", f"WITH {duck_lines('plain')} SELECT {_PLAIN_SEV} AS severity, count(*) AS n FROM l GROUP BY 1")
def severity_counts(spark, sf_dir):
    return lines(spark, sf_dir, "plain").select(sev.plain_severity(F.col("line")).alias("severity")).groupBy("severity").agg(F.count("*").alias("n"))


@query("http_status_severity", f"WITH {duck_lines('apache_common')}, q AS (SELECT CAST({_g(_AP, 5)} AS INT) AS status FROM l) SELECT status, {_HTTP.format('status')} AS severity, count(*) AS n FROM q GROUP BY 1, 2")
def http_status_severity(spark, sf_dir):
    status = F.regexp_extract("line", records.APACHE_COMMON, 5).cast("int")
    df = lines(spark, sf_dir, "apache_common").select(status.alias("status"))
    return df.groupBy("status", sev.http_severity(F.col("status")).alias("severity")).agg(F.count("*").alias("n"))


@query("severity_labels", f"WITH {duck_lines('plain')}, q AS (SELECT {_PLAIN_SEV} AS severity FROM l) SELECT severity, CASE severity WHEN 'Error' THEN 'Critical' ELSE severity END AS label, CASE severity WHEN 'Error' THEN 0 WHEN 'Warning' THEN 1 ELSE 2 END AS rank, count(*) AS n FROM q GROUP BY 1, 2, 3")
def severity_labels(spark, sf_dir):
    df = lines(spark, sf_dir, "plain").select(sev.plain_severity(F.col("line")).alias("severity"))
    return df.groupBy("severity", sev.display_label(F.col("severity")).alias("label"), sev.rank(F.col("severity")).alias("rank")).agg(F.count("*").alias("n"))


@query("priority_class", "SELECT CAST(user_id % 9 AS INT) AS priority, CASE WHEN user_id % 9 BETWEEN 1 AND 3 THEN 'high' WHEN user_id % 9 BETWEEN 4 AND 6 THEN 'medium' END AS class, count(*) AS n FROM events GROUP BY 1, 2")
def priority_class(spark, sf_dir):
    prepare(spark)
    p = (F.col("user_id") % 9).cast("int")
    return table(spark, sf_dir, "events").groupBy(p.alias("priority"), sev.priority_class(p).alias("class")).agg(F.count("*").alias("n"))


# The message pattern, stated again for the check.
_N1 = (
    r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}|"
    r"\d{2}\s+\w{3}\s+\d{4}\s+\d{2}:\d{2}:\d{2},\d{3}|\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|"
    r"\b[A-Za-z0-9+/]{20,}={0,2}#\d+\b|\b\d{5,}\b|\b0x[0-9a-fA-F]+\b|\bWorker\d+\b|https?://[^\s]+|\b\d+\.\d+\.\d+\.\d+\b|"
    r"/[\w/.-]+:\d+|\[[\w-]+-\d+\]|\bexec-\d+\b"
)


def _duck_pattern(x: str) -> str:
    return f"regexp_replace({x}, '{_N1}', '<DYNAMIC>', 'g')"


@query("normalize_messages", f"WITH {duck_lines('norm')} SELECT event_id, {_duck_pattern('line')} AS pattern, 'err-' || substr(md5({_duck_pattern('line')}), 1, 16) AS group_id FROM l")
def normalize_messages(spark, sf_dir):
    df = lines(spark, sf_dir, "norm").select("event_id", tx.message_pattern(F.col("line")).alias("pattern"))
    return df.withColumn("group_id", tx.group_id(F.col("pattern")))


@query("html_escape", "SELECT event_id, replace(replace(replace(replace(replace(props || '<b>''&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM events")
def html_escape(spark, sf_dir):
    prepare(spark)
    return table(spark, sf_dir, "events").select("event_id", tx.html_escape(F.concat("props", F.lit("<b>'&"))).alias("escaped"))


@query("truncate_messages", f"WITH {duck_lines('plain')} SELECT event_id, CASE WHEN strlen(line) > 80 THEN substr(line, 1, 80) || '... (truncated)' ELSE line END AS shown FROM l")
def truncate_messages(spark, sf_dir):
    return lines(spark, sf_dir, "plain").select("event_id", tx.truncate_message(F.col("line"), 80).alias("shown"))


_AGE = f"({AS_OF_US} // 1000000 - epoch_us(ts) // 1000000)"


@query(
    "time_ago",
    f"SELECT event_id, CASE WHEN {_AGE} < 60 THEN CAST({_AGE} AS VARCHAR) || ' seconds ago' WHEN {_AGE} < 3600 THEN CAST({_AGE} // 60 AS VARCHAR) || ' minutes ago' "
    f"WHEN {_AGE} < 86400 THEN CAST({_AGE} // 3600 AS VARCHAR) || ' hours ago' ELSE CAST({_AGE} // 86400 AS VARCHAR) || ' days ago' END AS age, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS at FROM events",
)
def time_ago(spark, sf_dir):
    prepare(spark)
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", tm.time_ago(ts, F.lit(AS_OF).cast("timestamp")).alias("age"), tm.absolute(ts).alias("at"))


@query(
    "duration_text",
    "SELECT event_id, CASE WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || 'h ' || CAST(s % 3600 // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's' "
    "WHEN s >= 60 THEN CAST(s // 60 AS VARCHAR) || 'm ' || CAST(s % 60 AS VARCHAR) || 's' ELSE CAST(s AS VARCHAR) || 's' END AS took FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)",
)
def duration_text(spark, sf_dir):
    prepare(spark)
    return table(spark, sf_dir, "events").select("event_id", tm.duration_text(F.col("event_id") * 7 % 9000).alias("took"))


@query(
    "parse_timestamps",
    f"WITH {duck_lines('times')} SELECT event_id, CASE event_id % 6 WHEN 0 THEN {_duck_rfc3339('line')} WHEN 1 THEN epoch_us(strptime(substr(line, 6), '%d %b %Y %H:%M:%S +0000')) "
    f"WHEN 2 THEN CAST(line AS BIGINT) * 1000 WHEN 3 THEN CAST(line AS BIGINT) * 1000000 WHEN 4 THEN epoch_us(strptime(line, '%Y/%m/%d %H:%M:%S')) ELSE {AS_OF_US} END AS ts_us FROM l",
)
def parse_timestamps(spark, sf_dir):
    found = tm.parse_timestamp(F.col("line"), AS_OF, [(r"^\d{4}/\d{2}/\d{2} ", "%Y/%m/%d %H:%M:%S"), ("(", "%Y")])
    return lines(spark, sf_dir, "times").select("event_id", us(found).alias("ts_us"))


# --- metadata ----------------------------------------------------------------------------------------------------

# The metadata patterns, stated again for the check.
_FL = r"""'"([^"]+\.(?:java|py|js|ts|cs|go|rs|cpp|c|h))",\s*line\s*(\d+)|(\w+\.(?:java|py|js|ts|cs|go|rs|cpp|c|h)):(\d+)'"""
_TH = r"'\[([^\]]+)\]|thread[_-]?(?:id)?[=:]?\s*([a-zA-Z0-9-]+)'"
_RQ = r"'(?:request[_-]?id|req[_-]?id|trace[_-]?id|correlation[_-]?id)[=:]?\s*([a-zA-Z0-9-]+)'"
_FN = r"'at\s+([a-zA-Z0-9_.]+)\('"


def _first_of(x: str, pattern: str, *groups: int) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {pattern}, {g}), '')" for g in groups) + ", NULL)"


@query(
    "extract_metadata",
    f"WITH {duck_lines('meta')} SELECT event_id, {_first_of('line', _FL, 1, 3)} AS file, {_first_of('line', _FL, 2, 4)} AS file_line, {_first_of('line', _TH, 1, 2)} AS thread, "
    f"{_first_of('line', _RQ, 1)} AS request_id, {_first_of('line', _FN, 1)} AS function FROM l",
)
def extract_metadata(spark, sf_dir):
    found = lines(spark, sf_dir, "meta").withColumn("m", md.extract(F.col("line")))
    x = lambda k: F.try_element_at("m", F.lit(k))
    return found.select("event_id", x("file").alias("file"), x("line").alias("file_line"), x("thread").alias("thread"), x("request_id").alias("request_id"), x("function").alias("function"))


@query("extract_custom", f"WITH {duck_lines('meta')} SELECT event_id, {_first_of('line', chr(39) + 'tenant=(' + chr(92) + 'w+)' + chr(39), 1)} AS tenant FROM l")
def extract_custom(spark, sf_dir):
    df = lines(spark, sf_dir, "meta")
    return df.select("event_id", *(c.alias(k) for k, c in md.custom_of(F.col("line"), {"tenant": r"tenant=(\w+)", "broken": "("}).items()))


@query(
    "stacktrace_top_frame",
    f"WITH {duck_lines('trace')}, q AS (SELECT event_id, list_filter(string_split(line, chr(10))[2:], lambda x: regexp_matches(x, {_FL})) AS frames FROM l) "
    f"SELECT event_id, {_first_of('frames[1]', _FL, 1, 3)} AS file, {_first_of('frames[1]', _FL, 2, 4)} AS file_line, {_first_of('frames[1]', _FN, 1)} AS function FROM q",
)
def stacktrace_top_frame(spark, sf_dir):
    found = lines(spark, sf_dir, "trace").withColumn("m", md.extract_from_stack_trace(F.col("line")))
    x = lambda k: F.try_element_at("m", F.lit(k))
    return found.select("event_id", x("file").alias("file"), x("line").alias("file_line"), x("function").alias("function"))


# --- grouping ----------------------------------------------------------------------------------------------------

_ENTRIES = (
    f"e AS (SELECT event_id AS entry_no, CASE WHEN event_id % 9 = 0 THEN NULL ELSE {_duck_rfc3339(_PLAIN_TS)} END AS t, {_PLAIN_SEV} AS severity, "
    f"regexp_replace(line, 'user [0-9]+$', 'user ' || CAST(event_id % 3 AS VARCHAR)) AS message FROM l)"
)
_GROUPED = (
    f"g AS (SELECT *, {_duck_pattern('message')} AS pattern FROM e WHERE severity IN ('Error', 'Warning')), "
    f"a AS (SELECT pattern, count(*) AS cnt, min(entry_no) AS first_no, min(t) AS low, max(t) AS high, arg_min(severity, entry_no) AS severity, "
    f"arg_min(coalesce(t, {AS_OF_US}), entry_no) AS start FROM g GROUP BY pattern)"
)
_GROUP_CTE = f"WITH {duck_lines('plain_z')}, {_ENTRIES}, {_GROUPED}"
_GROUP_COLUMNS = (
    "'err-' || substr(md5(pattern), 1, 16) AS group_id, pattern, cnt, least(start, coalesce(low, start)) AS first_us, "
    "greatest(start, coalesce(high, start)) AS last_us, severity"
)
_RANK = "CASE severity WHEN 'Error' THEN 0 WHEN 'Warning' THEN 1 ELSE 2 END"


#: What the grouping operators read of a record.
GROUPED_COLUMNS = ("ts", "severity", "message", "file", "file_line")


def _entries(spark, sf_dir) -> DataFrame:
    """Entries of plain lines, some without time, whose severities differ within a pattern."""
    df = lines(spark, sf_dir, "plain_z").withColumnRenamed("event_id", "entry_no").select("entry_no", "line")
    df = records.parse_plain(df, GROUPED_COLUMNS)
    return df.withColumn("ts", F.when(F.col("entry_no") % 9 != 0, F.col("ts"))).withColumn(
        "message", F.regexp_replace("message", F.lit("user [0-9]+$"), F.concat(F.lit("user "), (F.col("entry_no") % 3).cast("string")))
    )


def _flat(groups: DataFrame) -> DataFrame:
    return groups.select("group_id", "pattern", "cnt", us(F.col("first_seen")).alias("first_us"), us(F.col("last_seen")).alias("last_us"), "severity")


@query("group_errors_plain", f"{_GROUP_CTE} SELECT {_GROUP_COLUMNS} FROM a")
def group_errors_plain(spark, sf_dir):
    return _flat(gr.group_entries(_entries(spark, sf_dir), AS_OF))


@query("top_groups", f"{_GROUP_CTE} SELECT {_GROUP_COLUMNS} FROM a ORDER BY {_RANK}, cnt DESC, pattern LIMIT 4")
def top_groups(spark, sf_dir):
    return _flat(gr.ranked(gr.group_entries(_entries(spark, sf_dir), AS_OF), 4))


@query("severity_option", f"WITH {duck_lines('plain_z')}, {_ENTRIES}, {_GROUPED.replace(chr(39) + 'Error' + chr(39) + ', ' + chr(39) + 'Warning' + chr(39), chr(39) + 'Info' + chr(39))} SELECT pattern, cnt, severity FROM a")
def severity_option(spark, sf_dir):
    return gr.group_entries(_entries(spark, sf_dir), AS_OF, "info").select("pattern", "cnt", "severity")


_JSON_ENTRIES = (
    f"e AS (SELECT event_id AS entry_no, NULL::BIGINT AS t, CASE WHEN json_type(line, '$.level') = 'VARCHAR' THEN {_SEV_CASE.format(chr(117) + 'pper(json_extract_string(line, ' + chr(39) + '$.level' + chr(39) + '))')} ELSE 'Unknown' END AS severity, "
    "coalesce(json_extract_string(line, '$.message'), json_extract_string(line, '$.msg'), json_extract_string(line, '$.text')) AS message FROM l WHERE json_valid(line))"
)


@query("group_errors_json", f"WITH {duck_lines('json')}, {_JSON_ENTRIES}, {_GROUPED} SELECT pattern, cnt, severity, first_no FROM a")
def group_errors_json(spark, sf_dir):
    df = records.parse_json(lines(spark, sf_dir, "json").select(F.col("event_id").alias("entry_no"), "line"), GROUPED_COLUMNS)
    return gr.group_entries(df, AS_OF).select("pattern", "cnt", "severity", "first_no")


@query("group_examples", f"{_GROUP_CTE} SELECT pattern, cnt, e.message AS example_message FROM a JOIN e ON e.entry_no = a.first_no")
def group_examples(spark, sf_dir):
    df = _entries(spark, sf_dir)
    return gr.with_examples(gr.group_entries(df, AS_OF), df).select("pattern", "cnt", "example_message")


@query("occurrence_numbers", f"{_GROUP_CTE} SELECT entry_no, pattern, row_number() OVER (PARTITION BY pattern ORDER BY entry_no) AS occurrence FROM g")
def occurrence_numbers(spark, sf_dir):
    return gr.occurrences(_entries(spark, sf_dir), keep=("pattern",)).select("entry_no", "pattern", "occurrence")


@query("report_summary", f"{_GROUP_CTE} SELECT count(*) AS n_groups, CAST(sum(cnt) AS BIGINT) AS n_entries FROM a")
def report_summary(spark, sf_dir):
    return gr.totals(gr.group_entries(_entries(spark, sf_dir), AS_OF))


@query(
    "report_time_range",
    f"{_GROUP_CTE}, r AS (SELECT arg_min(coalesce(t, -1), entry_no) AS a, arg_max(coalesce(t, -1), entry_no) AS b FROM g GROUP BY pattern) "
    "SELECT CASE WHEN min(a) >= 0 THEN min(a) END AS start_us, CASE WHEN max(b) >= 0 THEN max(b) END AS end_us FROM r",
)
def report_time_range(spark, sf_dir):
    return gr.time_range(_entries(spark, sf_dir)).select(us(F.col("range_start")).alias("start_us"), us(F.col("range_end")).alias("end_us"))


@query(
    "prompt_build",
    f"{_GROUP_CTE}, n AS (SELECT pattern, message, row_number() OVER (PARTITION BY pattern ORDER BY entry_no) AS k FROM g), "
    "x AS (SELECT pattern, string_agg(CAST(k AS VARCHAR) || '. ' || message, chr(10) ORDER BY k) AS ex FROM n WHERE k <= 3 GROUP BY 1) "
    "SELECT a.pattern, 'Analyze this error pattern from application logs.' || chr(10) || chr(10) || 'Pattern: ' || a.pattern || chr(10) || 'Occurrences: ' || CAST(cnt AS VARCHAR) || chr(10) || "
    "'Severity: ' || severity || chr(10) || chr(10) || 'Examples:' || chr(10) || ex || chr(10) || chr(10) || "
    "'Answer with one JSON object with the keys \"explanation\", \"root_cause\" and \"suggestions\" (description, code_example, priority).' AS prompt FROM a JOIN x USING (pattern)",
)
def prompt_build(spark, sf_dir):
    df = _entries(spark, sf_dir)
    groups = gr.group_entries(df, AS_OF).join(gr.top_examples(df), "group_id")
    made = prompt(F.col("pattern"), F.col("cnt"), F.col("severity"), F.col("examples"))
    return groups.select("pattern", made.alias("prompt"))


def _raw_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "raw_lines").select(F.col("file_id").cast("string").alias("source"), "line_no", F.col("raw").alias("line"))


@query("investigate_lines")
def investigate_lines(spark, sf_dir):
    """The whole plan over the raw lines of all files: formats, stitching, parsing, grouping, ranking."""
    prepare(spark)
    return _flat(investigate(_raw_lines(spark, sf_dir), AS_OF, year=YEAR))


@query("enrich_groups", f"{_GROUP_CTE} SELECT pattern, cnt, 'about ' || pattern AS explanation, CAST(1 AS INT) AS attempts FROM a")
def enrich_groups(spark, sf_dir):
    """Groups with the analysis of a deterministic provider."""
    df = _entries(spark, sf_dir)
    groups = gr.group_entries(df, AS_OF)
    made = prompt(F.col("pattern"), F.col("cnt"), F.col("severity"), F.col("examples"))
    calls = enrich(groups.join(gr.top_examples(df), "group_id").select("group_id", made.alias("prompt")), MockProvider(), concurrency=2)
    return groups.join(calls, "group_id", "left").select("pattern", "cnt", F.col("analysis.explanation").alias("explanation"), "attempts")


# --- stitching ---------------------------------------------------------------------------------------------------

_C = (
    r"(regexp_matches(line, '^\s*at\s+[\w.$]+\(|^\s+File\s+" + '"[^"]+"' + r",\s+line\s+\d+|^\s+at\s+.*\.js:\d+|^\s+at\s+.*\sin\s+.*\.cs:line\s+\d+|^(?:goroutine\s+\d+|\t)|^\s*at |^(?:\t|  )') AND regexp_matches(line, '\S'))"
)
_STITCH = (
    f"WITH {duck_lines('stitch')}, f AS (SELECT CAST(user_id AS VARCHAR) AS source, event_id AS n, line, NOT regexp_matches(line, '\\S') AS blank, {_C} AS c, "
    "regexp_matches(line, '(?i)(?:Exception|Error|Traceback|Panic|Fatal|Caused by:)') AS e FROM l), "
    "s AS (SELECT *, sum(CASE WHEN NOT blank AND NOT c THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY n) AS seg FROM f), "
    "i AS (SELECT *, coalesce(max(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY source, seg ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS intr FROM s), "
    "h AS (SELECT *, NOT blank AND NOT (c AND intr) AS head FROM i), "
    "k AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY n) AS eid FROM h WHERE head OR intr), "
    "x AS (SELECT source, min(n) AS line_no, string_agg(line, chr(10) ORDER BY n) AS line, count(*) AS n_lines FROM k GROUP BY source, eid)"
)


def _stitched(spark, sf_dir) -> DataFrame:
    return stitch(lines(spark, sf_dir, "stitch").select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("line_no"), "line"))


@query("stitch_stacktraces", f"{_STITCH} SELECT source, line_no, line, n_lines FROM x")
def stitch_stacktraces(spark, sf_dir):
    return _stitched(spark, sf_dir)


@query(
    "multiline_stats",
    f"{_STITCH} SELECT (SELECT count(*) FROM l) AS total_lines, count(*) AS parsed_entries, CAST(0 AS BIGINT) AS parse_errors, sum(CASE WHEN contains(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), chr(10)) THEN 1 ELSE 0 END)::BIGINT AS multiline_entries, "
    "CAST(250 AS BIGINT) AS duration_ms, (SELECT count(*) FROM l) / 0.25 AS throughput, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM l) AS success_rate FROM x",
)
def multiline_stats(spark, sf_dir):
    entries = records.parse_plain(_stitched(spark, sf_dir).select("line"))
    return st.parsing_statistics(lines(spark, sf_dir, "stitch"), entries, 250)


@query("parse_stats", f"WITH {duck_lines('json')} SELECT count(*) AS total_lines, sum(CASE WHEN json_valid(line) THEN 1 ELSE 0 END)::BIGINT AS parsed_entries, sum(CASE WHEN json_valid(line) THEN 0 ELSE 1 END)::BIGINT AS parse_errors FROM l")
def parse_stats(spark, sf_dir):
    df = lines(spark, sf_dir, "json")
    return st.parse_counts(df, records.parse_json(df.select("line")))


# --- calls, cache, responses ---------------------------------------------------------------------------------------

_REASONS = "CASE event_id % 8 WHEN 0 THEN 'HTTP 429 rate limit' WHEN 1 THEN '401 Unauthorized' WHEN 2 THEN 'connection reset' WHEN 3 THEN 'JSON parse error at 400' WHEN 4 THEN '403 Forbidden' WHEN 5 THEN 'empty response' WHEN 6 THEN 'strange: ' || event_type || ' ' || repeat('x', 60) ELSE '400 bad request' END"
_CALLS = (
    "event_id AS call_id, event_id % 4 = 0 AS cached, event_type <> 'error' AS success, event_id % 900 AS duration_ms, CAST(1 + event_id % 3 AS INT) AS attempts, "
    f"CASE WHEN event_type = 'error' AND event_id % 4 <> 0 THEN {_REASONS} END AS failure_reason"
)


def _calls(spark, sf_dir) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, "events").selectExpr(*_split_select(_CALLS))


def _split_select(columns: str) -> list[str]:
    """The comma-separated columns of a select list; commas inside parentheses and texts don't count."""
    out, depth, inside, at = [], 0, False, 0
    for i, c in enumerate(columns):
        inside ^= c == "'"
        depth += 0 if inside else (c == "(") - (c == ")")
        if c == "," and not depth and not inside:
            out.append(columns[at:i])
            at = i + 1
    return [*out, columns[at:]]


@query(
    "analysis_stats",
    f"WITH c AS (SELECT {_CALLS} FROM events), s AS (SELECT count(*) AS total_calls, sum((cached OR success)::INT)::BIGINT AS successful, sum((NOT (cached OR success))::INT)::BIGINT AS failed, "
    "sum(cached::INT)::BIGINT AS cache_hits, sum((NOT cached)::INT)::BIGINT AS cache_misses, sum(CASE WHEN NOT cached AND success THEN duration_ms ELSE 0 END)::BIGINT AS total_ms FROM c) "
    "SELECT *, total_ms::DOUBLE / successful AS avg_ms, successful * 100.0::DOUBLE / total_calls AS success_rate, cache_hits * 100.0::DOUBLE / total_calls AS cache_hit_rate FROM s",
)
def analysis_stats(spark, sf_dir):
    return st.analysis_statistics(_calls(spark, sf_dir))


@query("retry_histogram", f"WITH c AS (SELECT {_CALLS} FROM events) SELECT attempts, count(*) AS n FROM c WHERE attempts > 1 GROUP BY 1")
def retry_histogram(spark, sf_dir):
    return st.retry_histogram(_calls(spark, sf_dir))


@query("top_failures", f"WITH c AS (SELECT {_CALLS} FROM events), t AS (SELECT failure_reason, count(*) AS n FROM c WHERE failure_reason IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT CASE WHEN length(failure_reason) > 60 THEN substr(failure_reason, 1, 60) || '...' ELSE failure_reason END AS reason, n FROM t")
def top_failures(spark, sf_dir):
    return st.top_failures(_calls(spark, sf_dir))


@query(
    "retry_classify",
    f"WITH c AS (SELECT event_id, lower({_REASONS}) AS r FROM events) SELECT event_id, CASE WHEN r LIKE '%timeout%' OR r LIKE '%timed out%' OR r LIKE '%connection%' OR r LIKE '%network%' OR r LIKE '%429%' OR r LIKE '%rate limit%' OR r LIKE '%500%' "
    "OR r LIKE '%502%' OR r LIKE '%503%' OR r LIKE '%empty response%' OR r LIKE '%json%' OR r LIKE '%parse%' THEN true WHEN r LIKE '%401%' OR r LIKE '%403%' OR r LIKE '%400%' OR r LIKE '%unauthorized%' OR r LIKE '%forbidden%' "
    "OR r LIKE '%authentication%' THEN false ELSE true END AS retry FROM c",
)
def retry_classify(spark, sf_dir):
    prepare(spark)
    return table(spark, sf_dir, "events").select("event_id", is_retryable(F.expr(_REASONS)).alias("retry"))


@query("backoff_schedule", "SELECT event_id % 12 AS attempt, least(1000 * CAST(pow(2, event_id % 12) AS BIGINT), 30000) AS delay_ms, count(*) AS n FROM events GROUP BY 1, 2")
def backoff_schedule(spark, sf_dir):
    prepare(spark)
    attempt = F.col("event_id") % 12
    return table(spark, sf_dir, "events").groupBy(attempt.alias("attempt"), backoff_ms(attempt, 1000, 30_000).alias("delay_ms")).agg(F.count("*").alias("n"))


def _cache_columns(number: str) -> str:
    return (
        f"'p' || CAST({number} AS STRING) AS pattern, CASE WHEN event_id % 2 = 0 THEN 'openai' ELSE 'ollama' END AS provider, 'm' AS model, 'e' || CAST(event_id AS STRING) AS explanation, "
        "CAST(NULL AS STRING) AS root_cause, CASE WHEN event_id % 3 = 0 THEN 'broken' ELSE '[{\"description\":\"d\",\"priority\":1}]' END AS suggestions, 1700000000 + event_id * 3600 AS created_at"
    )


def _cache(spark, sf_dir, number: str = "event_id") -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, "events").selectExpr(*_split_select(_cache_columns(number)))


@query(
    "cache_lookup",
    f"WITH c AS (SELECT {_cache_columns('event_id')} FROM events), g AS (SELECT 'p' || CAST(event_id * 3 AS VARCHAR) AS pattern FROM events), "
    "h AS (SELECT * FROM c WHERE provider = 'openai' AND model = 'm') SELECT pattern, explanation, CASE WHEN explanation IS NULL THEN NULL WHEN suggestions = 'broken' THEN 0 ELSE 1 END AS n_suggestions FROM g LEFT JOIN h USING (pattern)",
)
def cache_lookup(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    groups = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), (F.col("event_id") * 3).cast("string")).alias("pattern"))
    found = ca.lookup(groups, cache, "openai", "m")
    return found.select("pattern", "explanation", F.when(F.col("suggestions").isNotNull(), F.size("suggestions")).alias("n_suggestions"))


_REPEATED = "CASE WHEN event_id % 10 = 0 THEN event_id * 4 ELSE event_id - event_id % 10 + 2 END"


@query(
    "cache_upsert_repeated",
    f"WITH c AS (SELECT {_cache_columns('event_id')} FROM events), n AS (SELECT {_cache_columns(_REPEATED)} FROM events), u AS (SELECT pattern, provider, model, arg_max(explanation, created_at) AS explanation FROM n GROUP BY ALL) "
    "SELECT pattern, provider, explanation FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.pattern = c.pattern AND u.provider = c.provider) UNION ALL SELECT pattern, provider, explanation FROM u",
)
def cache_upsert_repeated(spark, sf_dir):
    """New rows that share their keys: the latest of each counts."""
    return ca.upsert(_cache(spark, sf_dir), _cache(spark, sf_dir, _REPEATED)).select("pattern", "provider", "explanation")


@query("cache_upsert", f"WITH c AS (SELECT {_cache_columns('event_id')} FROM events), n AS (SELECT {_cache_columns('event_id * 4')} FROM events) SELECT pattern, provider, explanation FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.pattern = c.pattern AND n.provider = c.provider AND n.model = c.model) UNION ALL SELECT pattern, provider, explanation FROM n")
def cache_upsert(spark, sf_dir):
    return ca.upsert(_cache(spark, sf_dir), _cache(spark, sf_dir, "event_id * 4")).select("pattern", "provider", "explanation")


@query("cache_expire", f"WITH c AS (SELECT {_cache_columns('event_id')} FROM events) SELECT pattern, provider, created_at FROM c WHERE created_at >= 1700000000 + 3600 * 200 - 5 * 86400")
def cache_expire(spark, sf_dir):
    return ca.expire(_cache(spark, sf_dir), 1_700_000_000 + 3600 * 200, 5).select("pattern", "provider", "created_at")


_RESPONSE = (
    "CASE event_id % 4 WHEN 0 THEN 'Sure:\n```json\n{\"explanation\": \"e' || CAST(event_id AS STRING) || ' {x}\", \"suggestions\": []}\n```' WHEN 1 THEN '{\"explanation\": \"a\nb\", \"suggestions\": [1, ]} tail' "
    "WHEN 2 THEN 'no object here' ELSE '{\"explanation\": \"only\"}' END"
)


@query(
    "response_extract",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'e' || CAST(event_id AS VARCHAR) || ' {x}' WHEN 1 THEN 'a' || chr(10) || 'b' END AS explanation, event_id % 4 >= 2 AS failed FROM events",
)
def response_extract(spark, sf_dir):
    prepare(spark)
    sql = _RESPONSE.replace("\n", "\\n")
    df = table(spark, sf_dir, "events").select("event_id", extract_response(F.expr(sql)).alias("r"))
    explanation = F.try_variant_get(F.try_parse_json(F.col("r.json")), "$.explanation", "string")
    return df.select("event_id", explanation.alias("explanation"), F.col("r.error").isNotNull().alias("failed"))


@query("typed_responses", "SELECT event_id, 'x' || CAST(event_id AS VARCHAR) AS explanation, CAST(1 AS INT) AS n, CAST(event_id % 6 AS SMALLINT) AS priority FROM events")
def typed_responses(spark, sf_dir):
    prepare(spark)
    text = F.concat(F.lit('{"explanation":"x'), F.col("event_id").cast("string"), F.lit('","suggestions":[{"description":"d","priority":'), (F.col("event_id") % 6).cast("string"), F.lit("}]}"))
    df = table(spark, sf_dir, "events").select("event_id", typed_response(text).alias("r"))
    return df.select("event_id", F.col("r.explanation").alias("explanation"), F.size("r.suggestions").alias("n"), F.col("r.suggestions")[0]["priority"].alias("priority"))


@query(
    "simple_responses",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' || CAST(event_id AS VARCHAR) END AS explanation, event_id % 3 = 0 AS taken FROM events",
)
def simple_responses(spark, sf_dir):
    """Fenced and typed without repair; a suggestion without priority, or none at all, gives nothing."""
    prepare(spark)
    tail = F.when(F.col("event_id") % 3 == 0, '[{"description":"d","priority":1}]').when(F.col("event_id") % 3 == 1, '[{"description":"d"}]').otherwise("null")
    text = F.concat(F.lit('```json\n{"explanation":"x'), F.col("event_id").cast("string"), F.lit('","suggestions":'), tail, F.lit("}\n```"))
    df = table(spark, sf_dir, "events").select("event_id", simple_response(text).alias("r"))
    return df.select("event_id", F.col("r.explanation").alias("explanation"), F.col("r").isNotNull().alias("taken"))


# --- reports and search --------------------------------------------------------------------------------------------


@query("masked_config", "SELECT event_id, 'name = \"' || event_type || '\"' || chr(10) || 'api_key = \"***\"' AS shown FROM events")
def masked_config(spark, sf_dir):
    prepare(spark)
    text = F.concat(F.lit('name = "'), F.col("event_type"), F.lit('"\napi_key = "k'), F.col("event_id").cast("string"), F.lit('"'))
    return table(spark, sf_dir, "events").select("event_id", tx.mask_api_key(text).alias("shown"))


@query("search_text", f"WITH {duck_lines('plain_z')} SELECT event_id FROM l WHERE contains(lower(line), lower('PURCHASE Failed'))")
def search_text(spark, sf_dir):
    return lines(spark, sf_dir, "plain_z").where(tx.contains_text(F.col("line"), "PURCHASE Failed")).select("event_id")


@query(
    "report_times",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S UTC') WHEN event_id % 3 = 1 THEN event_type || ' ' || CAST(user_id AS VARCHAR) ELSE 'No timestamp' END AS shown FROM events",
)
def report_times(spark, sf_dir):
    """The time of an entry as reports show it, where it has none the first two words of its line."""
    prepare(spark)
    three = F.col("event_id") % 3
    raw = F.when(three == 1, F.concat_ws(" ", "event_type", F.col("user_id").cast("string"), F.lit("more"))).otherwise(F.lit("word"))
    return table(spark, sf_dir, "events").select("event_id", tm.report_time(F.when(three == 0, F.col("ts").cast("timestamp")), raw).alias("shown"))


@query("observed_counts", f"{_STITCH} SELECT count(*) AS parsed_entries, sum(CASE WHEN contains(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), chr(10)) THEN 1 ELSE 0 END)::BIGINT AS multiline_entries FROM x")
def observed_counts(spark, sf_dir):
    """The counters that fill while the entries are written somewhere else."""
    entries, watch = st.observed(records.parse_plain(_stitched(spark, sf_dir).select("line")), f"parsing-{uuid.uuid4().hex}")
    entries.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(watch.get["parsed_entries"], watch.get["multiline_entries"])], "parsed_entries BIGINT, multiline_entries BIGINT")


@query("report_entries", f"{_GROUP_CTE} SELECT pattern, message, row_number() OVER (PARTITION BY pattern ORDER BY entry_no) AS occurrence FROM g WHERE pattern IN (SELECT pattern FROM a ORDER BY {_RANK}, cnt DESC, pattern LIMIT 4)")
def report_entries(spark, sf_dir):
    """A3: all entries of the groups that a report shows, none left out."""
    df = _entries(spark, sf_dir).withColumn("raw", F.col("message"))
    shown = gr.ranked(gr.group_entries(df, AS_OF), 4)
    return gr.entries_of(shown, df).join(shown.select("group_id", "pattern"), "group_id").select("pattern", "message", F.col("occurrence").cast("bigint").alias("occurrence"))


# --- text files ------------------------------------------------------------------------------------------------------


def _files(spark, sf_dir, template: str) -> str:
    """A folder of text files with the lines of a template, in the shared folder."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/{template}.txt"
    lines(spark, sf_dir, template).select("line").write.text(path)
    return path


@query("scan_files", f"WITH {duck_lines('plain')} SELECT line, count(*) AS n FROM l GROUP BY 1")
def scan_files(spark, sf_dir):
    """Lines of text files."""
    prepare(spark)
    return read_lines(spark, _files(spark, sf_dir, "plain")).groupBy("line").agg(F.count("*").alias("n"))


@query("scan_lossy", "SELECT event_id, 'a' || chr(65533) || CAST(event_id AS VARCHAR) AS line FROM events")
def scan_lossy(spark, sf_dir):
    """Files with a byte that is no UTF-8 in each line, and with line ends of CR LF."""
    prepare(spark)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/lossy.txt"
    broken = F.concat(F.unhex(F.lit("61FF")), F.concat(F.col("event_id").cast("string"), F.lit("\r")).cast("binary")).cast("string")
    table(spark, sf_dir, "events").select(broken.alias("line")).write.text(path)
    got = read_lines(spark, path)
    return got.select(F.regexp_extract("line", r"(\d+)$", 1).cast("bigint").alias("event_id"), "line")


@query(
    "two_sources_groups",
    f"WITH {duck_lines('plain_z')}, g AS (SELECT {_duck_pattern('line')} AS pattern FROM l WHERE {_PLAIN_SEV} IN ('Error', 'Warning')), "
    f"{duck_lines('nginx_error').replace('l AS', 'k AS', 1)}, h AS (SELECT {_duck_pattern(_g(_NE, 5).replace('(line', '(k.line'))} AS pattern FROM k WHERE {_g(_NE, 2).replace('(line', '(k.line')} IN ('crit', 'warn')) "
    "SELECT pattern, count(*) AS cnt FROM (SELECT pattern FROM g UNION ALL SELECT pattern FROM h) GROUP BY 1",
)
def two_sources_groups(spark, sf_dir):
    """Several inputs of different formats in one investigation."""
    prepare(spark)
    both = union_sources(spark, [_files(spark, sf_dir, "plain_z"), _files(spark, sf_dir, "nginx_error")])
    return investigate(both, AS_OF, year=YEAR).select("pattern", "cnt")


_CONTROL = f"replace(replace({{0}}, 'GET /', 'GET /' || chr(2) || 'x'), ' HTTP', chr(1) || ' HTTP')"


@query(
    "parse_control_bytes",
    f"WITH m AS (SELECT event_id, {_CONTROL.format(line_sql('apache_common', 'duck'))} AS line FROM events) SELECT event_id, {_g(_AP, 5)} || ' ' || {_g(_AP, 4)} AS message, {_g(_AP, 5)} AS status FROM m",
)
def parse_control_bytes(spark, sf_dir):
    """Lines that hold the bytes 1 and 2, which the parsers use inside."""
    df = lines(spark, sf_dir, "apache_common").select("event_id", F.expr(_CONTROL.format("line")).alias("line"))
    return records.parse_apache(df).select("event_id", "message", F.try_element_at("extra", F.lit("status")).alias("status"))


_BY_USER = {0: "stitch", 1: "nginx_error", 2: "syslog_3164"}
_INVESTIGATED = (
    _STITCH.replace("FROM l)", "FROM l WHERE user_id % 3 = 0)", 1)
    + f", q1 AS (SELECT user_id, event_id, {line_sql('nginx_error', 'duck')} AS line FROM events WHERE user_id % 3 = 1)"
    + f", q2 AS (SELECT user_id, event_id, {line_sql('syslog_3164', 'duck')} AS line FROM events WHERE user_id % 3 = 2)"
    + f", q3 AS (SELECT *, CAST({_g(_S3, 1)} AS INT) AS p FROM q2)"
    + f", e AS (SELECT source, line_no AS n, {_PLAIN_SEV} AS severity, trim(line, chr(9) || chr(10) || ' ') AS message FROM x"
    + f" UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, CASE {_g(_NE, 2)} WHEN 'crit' THEN 'Error' WHEN 'warn' THEN 'Warning' WHEN 'notice' THEN 'Info' ELSE 'Debug' END, {_g(_NE, 5)} FROM q1"
    + f" UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, {_PRI_SEV}, {_g(_S3, 5)} FROM q3)"
)


@query(
    "investigate_events",
    f"{_INVESTIGATED}, y AS (SELECT {_duck_pattern('message')} AS pattern, severity, source || chr(1) || lpad(CAST(n AS VARCHAR), 12, '0') AS place FROM e WHERE severity IN ('Error', 'Warning')) "
    "SELECT 'err-' || substr(md5(pattern), 1, 16) AS group_id, pattern, count(*) AS cnt, arg_min(severity, place) AS severity FROM y GROUP BY pattern",
)
def investigate_events(spark, sf_dir):
    """The whole investigation, M4 included, over a file for each user: format detection, stitching, parsing, grouping."""
    df = lines(spark, sf_dir, "stitch")
    made = F.when(F.col("user_id") % 3 == 0, F.col("line"))
    for k, template in list(_BY_USER.items())[1:]:
        made = made.when(F.col("user_id") % 3 == k, F.expr(line_sql(template, "spark")))
    files = df.select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("line_no"), made.alias("line"))
    return investigate(files, AS_OF, year=YEAR).select("group_id", "pattern", "cnt", "severity")


# --- streaming ---------------------------------------------------------------------------------------------------


@query("stream_group_counts", f"WITH {duck_lines('plain_z')}, g AS (SELECT {_duck_pattern('line')} AS pattern, {_PLAIN_SEV} AS severity FROM l) SELECT pattern, severity, count(*) AS cnt FROM g WHERE severity IN ('Error', 'Warning') GROUP BY 1, 2")
def stream_group_counts(spark, sf_dir):
    """The counts of the batch query, made by a stream over the same table."""
    prepare(spark)
    name = f"tidelog_stream_{uuid.uuid4().hex}"
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("line", F.expr(line_sql("plain_z", "spark")))
    out = f"{shared_dir(spark)}/{name}"
    q = (
        pattern_counts(stream.select("line")).writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.table(name)
