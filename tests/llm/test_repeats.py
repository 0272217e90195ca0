"""Problem 3 against a loop, over many chunks and merge levels."""

import random
import re

from pyspark.sql import functions as F

from tidelog.functions.text import PATTERN
from tidelog.llm.repeats import collapsed_events, repeated_events
from tidelog.operators import chunks

SCHEMA = "entry_id bigint, file_id bigint, entry_no bigint, message string"


def brute(rows, least=3):
    seen, out, run = set(), set(), None
    for _, f, n, m in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[2], r[0])):
        if (f, n) in seen:
            continue
        seen.add((f, n))
        key = None if m is None else re.sub("[^a-z]", "", re.sub(PATTERN, "<DYNAMIC>", m).lower())
        if run and run[0] == f and key is not None and run[4] == key:
            run[2], run[3] = n, run[3] + 1
        else:
            if run and run[3] >= least:
                out.add(tuple(run[:4]))
            run = [f, n, n, 1, key]
    if run and run[3] >= least:
        out.add(tuple(run[:4]))
    return out


def test_runs(spark, monkeypatch):
    monkeypatch.setattr(chunks, "FANOUT", 3)
    rng = random.Random(4)
    texts = ["User 12345 in", "USER 99999 IN!", "other", "", "123", None, "Worker1 died", "worker died"]
    rows, i = [], 0
    for f, size in ((1, 1500), (2, 40), (3, 1), (4, 700)):
        n = 0
        while n < size:
            m = "same event" if f == 4 else rng.choice(texts)
            for _ in range(rng.randint(1, 6)):
                n += rng.randint(1, 2)
                i += 1
                rows.append((i, f, n, m))
                if rng.random() < 0.1:
                    i += 1
                    rows.append((i, f, n, "redelivered"))
    rows += [(i + 1, None, 1, "same"), (i + 2, 1, None, "same"), (i + 3, 9, 1, "x" * 100_000)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumn("key", F.lit("k")).withColumn("grp", F.lit(0))
        got = [tuple(r) for r in repeated_events(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert any(r[0] == 4 and r[3] > 300 for r in got)
    assert repeated_events(df.where("false")).count() == 0


def test_durations(spark):
    rows = [(1, 1, 1, "s", "plain", "2024-01-01T00:00:00Z", None, "a 1"), (2, 1, 2, "s", "plain", "never", None, "a 2"), (3, 1, 5, "s", "plain", "2024-01-01T00:00:03Z", None, "a 3"), (4, 1, 6, "s", "plain", None, None, "b")]
    df = spark.createDataFrame(rows, "entry_id bigint, file_id bigint, entry_no bigint, source string, format string, ts_text string, raw string, message string").withColumn("ingested_at", F.lit("2025-01-01").cast("timestamp"))
    sources = spark.createDataFrame([("s", "UTC", "dmy")], "source string, tz string, date_order string")
    got = sorted(tuple(r) for r in collapsed_events(df, sources).collect())
    assert got == [(1, 1, 5, 3, 3_000_000), (1, 6, 6, 1, None)]
