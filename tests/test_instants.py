"""Problem 2: notations, zones, skipped and doubled wall clocks, missing years, impossible dates."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidelog.operators.instants import certain_instants, resolve_instants

SCHEMA = "entry_id bigint, source string, format string, ts_text string, raw string, ingested_at timestamp"
SOURCES = [("ny", "America/New_York", "mdy"), ("be", "Europe/Berlin", "dmy"), ("none", None, "dmy"), ("bad", "Mars/Base", None), ("lh", "Australia/Lord_Howe", "dmy")]


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


def resolve(spark, rows):
    sources = spark.createDataFrame(SOURCES, "source string, tz string, date_order string")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return {r.entry_id: r.epoch_us for r in resolve_instants(df, sources).collect()}


IN = datetime(2025, 6, 1)
CASES = [
    ("ny", "2024-10-18T01:15:54.901876Z", us(2024, 10, 18, 1, 15, 54) + 901876),
    ("ny", "2024-10-18t01:15:54.9z", us(2024, 10, 18, 1, 15, 54) + 900000),
    ("ny", "2024-10-18T01:15:54.123456789Z", us(2024, 10, 18, 1, 15, 54) + 123456),
    ("none", "2024-10-18 01:15:54,5+02", us(2024, 10, 17, 23, 15, 54) + 500000),
    ("none", "2024-10-18 01:15:54", None),
    ("ny", "2024-11-03 01:30:00", None),  # shown twice
    ("ny", "2024-03-10 02:30:00", None),  # skipped
    ("ny", "2024-11-03 03:30:00", us(2024, 11, 3, 8, 30)),
    ("lh", "2025-04-06 01:45:00", None),  # a change by half an hour
    ("lh", "2025-04-06 02:15:00", us(2025, 4, 5, 15, 45)),
    ("be", "2024-10-27 02:30:00 CEST", us(2024, 10, 27, 0, 30)),
    ("be", "2024-10-27 02:30:00 CET", us(2024, 10, 27, 1, 30)),
    ("none", "2024-10-27 02:30:00 CET", None),
    ("none", "2024-10-27 02:30:00 UTC", us(2024, 10, 27, 2, 30)),
    ("ny", "3/4/2025 5:07:04 PM", us(2025, 3, 4, 22, 7, 4)),
    ("be", "03/04/2025 05:07:04", us(2025, 4, 3, 3, 7, 4)),
    ("ny", "15.10.2024 12:00:00", us(2024, 10, 15, 16)),
    ("bad", "03/04/2025 05:07:04 UTC", None),
    ("ny", "14/Oct/2024:22:03:52 -0500", us(2024, 10, 15, 3, 3, 52)),
    ("ny", "Sun, 29 Dec 2024 04:07:00 GMT", us(2024, 12, 29, 4, 7)),
    ("be", "25 Dec 2024 20:43:24,345", us(2024, 12, 25, 19, 43, 24) + 345000),
    ("be", "Fri Nov  1 20:24:24 2024", us(2024, 11, 1, 19, 24, 24)),
    ("none", "1729171298.314", 1729171298314000),
    ("none", "1729187186987", 1729187186987000),
    ("none", "1729021713148284", 1729021713148284),
    ("none", "20241016T022951Z", us(2024, 10, 16, 2, 29, 51)),
    ("ny", "2025-02-30T11:04:09Z", None),
    ("ny", "2024-02-29T00:00:00Z", us(2024, 2, 29)),
    ("ny", "2024-10-18T24:00:00Z", None),
    ("ny", "13/01/2025 1:00:00 PM", None),
    ("ny", "1/13/2025 13:00:00 PM", None),
    ("ny", "2024-10-18T01:15:54+05:45[Asia/Kathmandu]", us(2024, 10, 17, 19, 30, 54)),
    ("ny", "yesterday 10:15", None), ("ny", "", None), ("ny", "-", None), ("bad", "2024-10-18 01:15:54", None), (None, "2024-10-18 01:15:54Z", us(2024, 10, 18, 1, 15, 54)),
    ("be", "Jun  1 01:59:59", us(2025, 5, 31, 23, 59, 59)),
    ("be", "Jun  1 02:00:01", us(2024, 6, 1, 0, 0, 1)),
    ("be", "Feb 29 10:00:00", us(2024, 2, 29, 9)),
    ("be", "Feb 30 10:00:00", None),
]


def test_notations(spark):
    got = resolve(spark, [(s, "plain", t, None, IN) for s, t, _ in CASES])
    wrong = [(s, t, got[i], want) for i, (s, t, want) in enumerate(CASES) if got[i] != want]
    assert not wrong


@pytest.mark.parametrize(
    "fmt, raw",
    [
        ("json", '{"level":"x","time":"2024-10-18T01:15:54Z","msg":"a, b"}'),
        ("json", '{"@timestamp": 1729214154, "text": "a"}'),
        ("apache", '1.2.3.4 - - [18/Oct/2024:03:15:54 +0200] "GET /" 200 1'),
        ("nginx", "2024/10/18 03:15:54 [warn] 1#1: x"),
        ("syslog", "<14>Oct 18 03:15:54 h app[1]: x"),
        ("syslog", "<14>1 2024-10-18T01:15:54Z h app - - x"),
        ("plain", "[2024-10-18T03:15:54.000+02:00[Europe/Berlin]] INFO x - y"),
        ("plain", "Fri Oct 18 03:15:54 2024  INFO 1 --- [main] X : y"),
        ("plain", "18.10.2024 03:15:54  WARN 1 --- [main] X : y"),
    ],
)
def test_time_in_raw(spark, fmt, raw):
    assert resolve(spark, [("be", fmt, None, raw, IN)]) == {0: us(2024, 10, 18, 1, 15, 54)}


def test_edges(spark):
    rows = [(None, None, None, None, None), ("ny", "plain", "Oct  1 00:00:00", None, None), ("ny", "plain", "x" * 100_000, "y" * 100_000, IN)]
    assert set(resolve(spark, rows).values()) == {None}
    sources = spark.createDataFrame(SOURCES, "source string, tz string, date_order string")
    empty = spark.createDataFrame([], SCHEMA)
    assert certain_instants(empty, sources).count() == 0
    one = spark.createDataFrame([(1, "ny", "plain", "2024-10-18T00:00:00Z", None, IN)] * 2, SCHEMA).withColumn("epoch_us", F.lit(1)).withColumn("tz", F.lit("x"))
    assert [r.epoch_us for r in resolve_instants(one, sources).collect()] == [us(2024, 10, 18)] * 2
    assert certain_instants(one, sources.where("false")).count() == 2
