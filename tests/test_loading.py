"""Problem 6: reasons in order, typed values, unknown delimiters, edge cases."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.operators.loading import _unquoted_quote, assemble_rows, bad_rows, file_counts, load_lines, load_row, load_rows

OK = "2025-01-27T14:52:07+01:00;Error;Job;a.py;12;p;0.5;text"


def reason(raw, delimiter=";"):
    return load_row(raw, delimiter, _unquoted_quote(delimiter))[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        (OK, None),
        (OK.replace("text", '"a;b ""c""\n d"'), None),
        (OK.replace("T14", " 14").replace("Error", "eRRor"), None),
        (OK.replace("12;p;0.5", ";;"), None),
        (OK.replace("text", '"open'), "quoting"),
        (OK.replace("Job", '"Job" x'), "quoting"),
        (OK.replace("text", 'a "b" c'), "quoting"),
        ('"', "quoting"),
        ("", "column_count"),
        ("  ", "column_count"),
        (None, "column_count"),
        (OK + ";x", "column_count"),
        (OK.replace(";", ","), "column_count"),
        (OK.replace("+01:00", ""), "invalid_value"),
        (OK.replace("01-27", "02-30"), "invalid_value"),
        (OK.replace("14:52", "24:52"), "invalid_value"),
        (OK.replace("Error", "SEVERE"), "invalid_value"),
        (OK.replace("Job", ""), "invalid_value"),
        (OK.replace(";12;", ";-1;"), "invalid_value"),
        (OK.replace(";12;", ";4294967296;"), "invalid_value"),
        (OK.replace(";12;", ";4294967295;"), None),
        (OK.replace("0.5", "1e3"), "invalid_value"),
        (OK.replace("0.5", "NaN"), "invalid_value"),
        (OK.replace("0.5", "9" * 60), None),
    ],
)
def test_reasons(raw, want):
    assert reason(raw) == want


@pytest.mark.parametrize(
    "line, duration, want",
    [
        ("12", "1" * 20, (None, 12, Decimal("1" * 20))),
        ("12", "9" * 29, (None, 12, Decimal("9" * 29))),
        ("12", "9" * 29 + ".1234567891", (None, 12, Decimal("9" * 29 + ".123456789"))),
        ("12", "9" * 29 + ".9999999999", (None, 12, None)),
        ("12", "1" * 30, (None, 12, None)),
        ("12", "1" * 5000, (None, 12, None)),
        ("12", "0.0000000025", (None, 12, Decimal("0.000000002"))),
        ("9" * 5000, "0.5", ("invalid_value", None, None)),
        ("0" * 5000 + "7", "0.5", (None, 7, Decimal("0.5"))),
        ("0" * 5000, "0.5", (None, 0, Decimal("0.5"))),
    ],
)
def test_long_numbers(spark, line, duration, want):
    raw = OK.replace(";12;", f";{line};").replace("0.5", duration)
    row = load_row(raw, ";", _unquoted_quote(";"))
    assert (row[0], row[5], row[7]) == want
    df = spark.createDataFrame([(1, 1, 1, raw)], ROWS)
    out = load_rows(df, spark.createDataFrame([(1, "rows", ";", 0)], STATS)).first()
    assert (out.reason, out.line, out.duration_ms) == want


ROWS = "row_id bigint, file_id bigint, row_no bigint, raw string"
STATS = "file_id bigint, kind string, delimiter string, parse_errors bigint"


def test_typed_fields_and_counts(spark):
    stats = spark.createDataFrame([(1, "rows", ";", 1), (1, "rows", ";", None), (2, "rows", None, None), (1, "lines", "|", 9)], STATS)
    rows = [(1, 1, 1, OK), (2, 1, 2, OK.replace("Error", "x")), (2, 1, 2, OK.replace("Error", "x")), (3, 2, 1, OK.replace(";", ",")), (4, None, 1, ""), (5, 1, 3, OK.replace("text", "t" * 300_000))]
    df = spark.createDataFrame(rows, ROWS).withColumn("delimiter", F.lit("?")).withColumn("reason", F.lit("old"))
    out = load_rows(df, stats)
    assert out.count() == 6 and out.schema.fieldNames()[:4] == ["row_id", "file_id", "row_no", "reason"]
    r = out.where("row_id = 1").first()
    assert (r.severity, r.line, r.duration_ms, str(r.ts), r.message) == ("Error", 12, Decimal("0.5"), "2025-01-27 13:52:07", "text")
    assert sorted(tuple(x) for x in bad_rows(df, stats).collect()) == [(2, "invalid_value"), (2, "invalid_value"), (4, "column_count")]
    got = {x.file_id: (x.n_rows, x.n_bad, x.parse_errors) for x in file_counts(df, stats).collect()}
    assert got == {1: (4, 2, 1), 2: (1, 0, None), None: (1, 1, None)}
    assert load_rows(df.where("false"), stats).count() == 0


def test_rows_are_assembled_over_many_chunks(spark):
    rng = random.Random(6)
    pool = ["a;b", 'a;"b', 'c";d', '"x ""y"" z"', "", '"', OK]
    rows = [(f, n, rng.choice(pool)) for f, size in ((1, 2000), (2, 7), (3, 1)) for n in range(size)]
    want = set()
    for f in (1, 2, 3):
        row, quotes = None, 0
        for _, n, x in [r for r in rows if r[0] == f]:
            if quotes % 2 and x != OK:
                row[1].append(x)
            else:
                if row:
                    want.add((f, row[0], "\n".join(row[1])))
                row, quotes = (n, [x]), 0
            quotes += x.count('"')
        want.add((f, row[0], "\n".join(row[1])))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows + [(None, 1, "x")], "file_id bigint, line_no bigint, line string").repartition(5)
        stats = spark.createDataFrame([(f, "rows", ";", 0) for f in (1, 2, 3)], STATS)
        got = [tuple(r)[:3] for r in assemble_rows(df, stats).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(want) and set(got) == want
    assert assemble_rows(df.where("false"), stats).count() == 0


def test_a_quote_left_open_costs_no_good_row(spark):
    quoted = OK.replace("text", '"two\nlines"')
    lines = [OK, OK.replace("text", '"never closed'), OK.replace("Job", "Next"), *quoted.split("\n"), "a;b"]
    df = spark.createDataFrame([(1, n, x) for n, x in enumerate(lines)], "file_id bigint, line_no bigint, line string")
    out = load_lines(df, spark.createDataFrame([(1, "rows", ";", 0)], STATS))
    got = {r.row_no: (r.reason, r.component, r.message) for r in out.collect()}
    assert got == {0: (None, "Job", "text"), 1: ("quoting", None, None), 2: (None, "Next", "text"), 3: (None, "Job", "two\nlines"), 5: ("column_count", None, None)}


def test_private_characters_stay():
    row = load_row(OK.replace("text", '"a\ue00a\ue00d""\nb\r"'), ";", _unquoted_quote(";"))
    assert row[0] is None and row[-1] == 'a\ue00a\ue00d"\nb\r'
