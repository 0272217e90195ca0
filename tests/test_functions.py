"""Expressions with literal expectations: N1, N2, H1, H2, H4, P2, P6, P10, P14, P17, T1-T9, J0-J7, H7."""

import pytest
from pyspark.sql import functions as F

from tidelog.formats.records import json_guard
from tidelog.functions import responses as rs
from tidelog.functions import severity as sev
from tidelog.functions import text as tx
from tidelog.functions import timestamps as tm


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "message, pattern",
    [
        ("User 123456 not found", "User <DYNAMIC> not found"),
        ("User 1234 not found", "User 1234 not found"),
        ("at 2024-01-02T03:04:05.678Z", "at <DYNAMIC>"),
        ("at 2024/01/02 03:04:05 x", "at <DYNAMIC> x"),
        ("01 Feb 2024 03:04:05,678 x", "<DYNAMIC> x"),
        ("id 123e4567-e89b-12d3-a456-426614174000.", "id <DYNAMIC>."),
        ("ptr 0xfe12 Worker7 exec-3", "ptr <DYNAMIC> <DYNAMIC> <DYNAMIC>"),
        ("get https://a.example/b?c=1 now", "get <DYNAMIC> now"),
        ("from 10.0.0.1 at /srv/a-b.c:12", "from <DYNAMIC> at <DYNAMIC>"),
        ("[pool-1-thread-2] x", "<DYNAMIC> x"),
        ("é12345 ٣٤٥٦٧", "é12345 <DYNAMIC>"),
        ("", ""),
        (None, None),
    ],
)
def test_n1_message_pattern(spark, message, pattern):
    assert one(spark, tx.message_pattern, message) == pattern


def test_n2_group_id(spark):
    assert one(spark, tx.group_id, "abc") == "err-900150983cd24fb0"


def test_h1_h2_h4(spark):
    assert one(spark, tx.html_escape, "<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert one(spark, lambda c: tx.truncate_message(c, 4), "äöüß") == "äöüß... (truncated)"
    assert one(spark, lambda c: tx.truncate_message(c, 8), "äöüß") == "äöüß"
    assert one(spark, tx.mask_api_key, 'api_key = "secret"') == 'api_key = "***"'


@pytest.mark.parametrize("line, label", [("x ERROR y", "Error"), ("x error_code Warn y", "Warning"), ("ERROR_CODE", "Unknown"), ("fatal", "Error"), ("trace", "Trace")])
def test_p6_plain_severity(spark, line, label):
    assert one(spark, sev.plain_severity, line) == label


def test_other_severities(spark):
    assert [one(spark, sev.json_severity, x) for x in ("FATAL", "information", "3", None)] == ["Error", "Info", "Unknown", "Unknown"]
    assert [one(spark, sev.http_severity, x, "int") for x in (200, 404, 500, 600)] == ["Info", "Warning", "Error", "Info"]
    assert [one(spark, sev.nginx_severity, x) for x in ("emerg", "warn", "notice", "odd")] == ["Error", "Warning", "Info", "Unknown"]
    assert [one(spark, sev.syslog_severity, x, "bigint") for x in (34, 36, 38, 191, 300, None)] == ["Error", "Warning", "Info", "Debug", "Error", "Error"]
    assert one(spark, lambda c: sev.label(sev.code(c)), "Warning") == "Warning"


@pytest.mark.parametrize(
    "text, micros",
    [
        ("2024-01-01T00:00:00Z", 1704067200000000),
        ("2024-01-01 01:00:00.5+01:00", 1704067200500000),
        ("2024-01-01T00:00:00", None),
        ("2024-01-01T00:00:00+0000", None),
        ("2024-02-30T00:00:00Z", None),
        (None, None),
    ],
)
def test_t1_rfc3339(spark, text, micros):
    assert one(spark, lambda c: F.unix_micros(tm.rfc3339(c)), text) == micros


def test_t2_t3_t4_t5(spark):
    us = F.unix_micros
    assert one(spark, lambda c: us(tm.rfc2822(c)), "Mon, 01 Jan 2024 01:00:00 +0100") == 1704067200000000
    assert one(spark, lambda c: us(tm.rfc2822(c)), "1 Jan 2024 00:00:00 GMT") == 1704067200000000
    assert one(spark, lambda c: us(tm.unix_epoch(c)), "1704067200") == 1704067200000000
    assert one(spark, lambda c: us(tm.unix_epoch(c)), "1704067200123") == 1704067200123000
    custom = [("(", "%Y"), (r"^\d{2}\.", "%d.%m.%Y %H:%M:%S")]
    assert one(spark, lambda c: us(tm.custom(c, custom)), "01.01.2024 00:00:00") == 1704067200000000
    assert one(spark, lambda c: us(tm.parse_timestamp(c, "2024-01-01", custom)), "no time") == 1704067200000000


@pytest.mark.parametrize("seconds, text", [(59, "59 seconds ago"), (60, "1 minutes ago"), (3600, "1 hours ago"), (86400 * 2, "2 days ago")])
def test_t6_time_ago(spark, seconds, text):
    assert one(spark, lambda c: tm.time_ago(F.timestamp_seconds(F.lit(10**9) - c), F.timestamp_seconds(F.lit(10**9))), seconds, "bigint") == text


def test_t8_t9(spark):
    assert one(spark, lambda c: tm.report_time(F.lit(None).cast("timestamp"), c), "Jan 1 x") == "Jan 1"
    assert one(spark, lambda c: tm.report_time(F.lit(None).cast("timestamp"), c), "x") == "No timestamp"
    assert [one(spark, tm.duration_text, x, "bigint") for x in (5, 65, 3665)] == ["5s", "1m 5s", "1h 1m 5s"]


@pytest.mark.parametrize("text, ok", [('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}{"b":2}', False), ("{'a':1}", False), ('{"a":01}', False), ("[1]", False), ("", False)])
def test_j0_guard(spark, text, ok):
    assert one(spark, json_guard, text) is ok


def test_j1_to_j6(spark):
    fenced = 'Sure\n```json\n{"explanation": "a {b}", "suggestions": []}\n```'
    assert one(spark, lambda c: rs.extract_response(c)["json"], fenced) == '{"explanation": "a {b}", "suggestions": []}'
    assert one(spark, lambda c: rs.extract_response(c)["error"], "nothing").startswith("no valid JSON object")
    assert one(spark, lambda c: rs.extract_response(c)["json"], '{"explanation": "x"}') is None
    assert rs.sanitize('{"a": "b\nc"}\n') == '{"a": "b\\nc"}\n'
    assert rs.balanced_object('x {"a": "}"} y') == '{"a": "}"}'
    assert rs.JsonText.extract(fenced).error is None
    good = '{"explanation":"e","suggestions":[{"description":"d","priority":2}]}'
    assert one(spark, lambda c: rs.simple_response(c)["suggestions"][0]["priority"], good) == 2
    assert one(spark, rs.simple_response, good.replace(',"priority":2', "")) is None


def test_h7_h8(spark):
    cases = {"Connection refused": True, "HTTP 401": False, "json at 400": True, "strange": True, "authentication failed": False}
    for text, retry in cases.items():
        assert one(spark, rs.is_retryable, text) is retry and rs.retry_worthy(text) is retry
    assert [one(spark, lambda c: rs.backoff_ms(c, 1000, 30_000), n, "int") for n in (0, 3, 9)] == [1000, 8000, 30000]
