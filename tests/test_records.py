"""Record formats, detection and the whole plan on small texts."""

from pyspark.sql import functions as F

from tidelog.formats import records
from tidelog.formats.registry import parse
from tidelog.operators.detect import detect_from_samples, detect_sources, format_of
from tidelog.plans.pipeline import investigate, parse_lines

SAMPLES = {
    "json": '{"level":"error","message":"down","timestamp":"2024-01-01T00:00:00Z","user":"u","n":3}',
    "apache": '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 500 2326 "-" "agent"',
    "nginx": "2024/01/01 00:00:00 [error] 12#34: *5 connect() failed",
    "syslog": "<34>Oct 11 22:14:15 host app[123]: it failed",
    "plain": "2024-01-01T00:00:00Z WARN slow",
}


def frame(spark, lines, source="s"):
    return spark.createDataFrame([(source, i, x) for i, x in enumerate(lines)], "source string, line_no bigint, line string")


def parsed(spark, name, lines):
    return parse(frame(spark, lines), name, 2024).orderBy("line_no").collect()


def test_d1_formats(spark):
    got = {r.line: r.f for r in frame(spark, [*SAMPLES.values(), "", " {"]).withColumn("f", format_of(F.col("line"))).collect()}
    assert {k: got[v] for k, v in SAMPLES.items()} == {k: k for k in SAMPLES}
    assert got[""] == got[" {"] == "plain"


def test_nginx_access_lines_are_detected_as_apache(spark):
    line = '1.2.3.4 - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.1" 200 12 0.005'
    assert frame(spark, [line]).select(format_of(F.col("line"))).first()[0] == "apache"
    (r,) = parsed(spark, "nginx", [line])
    assert r.extra["response_time"] == "0.005" and r.severity == "Info"


def test_d3_votes(spark):
    df = frame(spark, [SAMPLES["json"], SAMPLES["syslog"], SAMPLES["syslog"]], "a").unionByName(frame(spark, ["x"], "b"))
    assert dict(detect_from_samples(df).collect()) == {"a": "syslog", "b": "plain"}
    assert dict(detect_sources(df).collect()) == {"a": "json", "b": "plain"}


def test_p1_json(spark):
    rows = parsed(spark, "json", [SAMPLES["json"], '{"msg":5,"severity":"WARN","line":4294967297,"func":"f"}', "{} x", "[]", '{"a":1,"a":2}'])
    assert [r.severity for r in rows] == ["Error", "Warning", "Unknown"]
    assert rows[0].extra == {"user": "u"} and rows[0].message == "down"
    assert rows[1].message == "" and rows[1].file_line == 1 and rows[1].function == "f"


def test_p7_apache(spark):
    (r,) = parsed(spark, "apache", [SAMPLES["apache"]])
    assert (r.severity, r.message) == ("Error", "500 GET /a HTTP/1.0")
    assert r.extra == {"client_ip": "127.0.0.1", "user": "frank", "status": "500", "response_size": "2326", "user_agent": "agent"}


def test_p12_p15_p16(spark):
    (n,) = parsed(spark, "nginx", [SAMPLES["nginx"]])
    assert n.message == "*5 connect() failed" and n.extra == {"pid": "12", "tid": "34", "level": "error"}
    old, new = parsed(spark, "syslog", [SAMPLES["syslog"], "<165>1 2003-10-11T22:14:15.003Z host app - ID47 - text"])
    assert old.extra == {"priority": "34", "hostname": "host", "app_name": "app", "pid": "123"} and old.severity == "Error"
    assert str(old.ts) == "2024-10-11 22:14:15"
    assert new.message == "- text" and new.extra == {"priority": "165", "hostname": "host", "app_name": "app"}


def test_p5_plain_needs_a_zone(spark):
    rows = parsed(spark, "plain", ["2024-01-01 00:00:00 ERROR x", "a 2024-01-01 00:00:00Z ERR", "   ", ""])
    assert [r.ts is None for r in rows] == [True, False]


def test_input_columns_stay_and_clash_safely(spark):
    df = frame(spark, [SAMPLES["plain"]]).withColumn("keep", F.lit(1)).withColumn("message", F.lit("old"))
    r = records.parse_plain(df).first()
    assert r.keep == 1 and r.message == SAMPLES["plain"]


TRACE = ["2024-01-01T00:00:00Z ERROR Failed: SQLException", "\tat a.B.c(D.java:1)", "2024-01-01T00:00:00Z ERROR Failed: SQLException", "\tat a.B.c(D.java:1)", "\tat a.B.d(D.java:2)", "2024-01-01T00:00:01Z WARN slow"]


def test_grouping_differs_with_stitching(spark):
    lines = frame(spark, TRACE)
    flat = investigate(lines, "2024-06-01", fmt="plain", multiline=False).collect()
    assert [(r.severity, r.cnt) for r in flat] == [("Error", 2), ("Warning", 1)]
    whole = investigate(lines, "2024-06-01", fmt="plain").collect()
    assert [(r.severity, r.cnt) for r in whole] == [("Error", 1), ("Error", 1), ("Warning", 1)]


def test_auto_formats_by_source(spark):
    df = frame(spark, [SAMPLES["json"]], "a").unionByName(frame(spark, [SAMPLES["syslog"]], "b")).unionByName(frame(spark, TRACE, "c"))
    got = {(r.source, r.format) for r in parse_lines(df, year=2024).collect()}
    assert got == {("a", "json"), ("b", "syslog"), ("c", "plain")}


def test_json_with_continuation_is_dropped(spark):
    df = frame(spark, ['{"level":"error","message":"x"}', "  more"])
    assert parse_lines(df, "json").count() == 0 and parse_lines(df, "json", multiline=False).count() == 1


def test_group_without_first_time_counts_as_now(spark):
    df = frame(spark, ["ERROR a", "2024-01-01T00:00:00Z ERROR a"]).withColumn("entry_no", F.col("line_no"))
    from tidelog.operators.grouping import group_entries

    entries = records.parse_plain(df).withColumn("message", F.lit("same"))
    r = group_entries(entries, "2024-06-01 00:00:00").first()
    assert str(r.first_seen) == "2024-01-01 00:00:00" and str(r.last_seen) == "2024-06-01 00:00:00"


def test_empty_input(spark):
    assert investigate(frame(spark, []), "2024-06-01").count() == 0
