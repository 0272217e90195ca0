"""Problem 5: layouts, entries over several lines, files in many chunks, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import chunks
from tidelog.operators.fields import Layouts, TemplateTree, entries_of_lines, header_of, learn_templates

CASES = [
    ('{"timestamp": "2025-01-12T15:00:18.453Z", "level": "information", "component": "a.b.c", "text": "x"}', ("Info", "a.b.c", "x")),
    ('{"message": "x", "severity": 3, "time": 5}', ("Unknown", "", "x")),
    ('{"a": 1}', None),
    ("{", None),
    ('level=warn ts=2025-03-03T19:11:07.525Z msg="a \\"b\\" c" component=dorvik-sync took=314ms', ("Warning", "dorvik-sync", 'a "b" c')),
    ("<14>Mar  3 11:11:31 host mirelle-sync[4172]: it works", ("Info", "mirelle-sync", "it works")),
    ('<54>1 2025-01-22T19:57:11.113Z host ostrel-gateway - ID7 [meta seq="0"] ok', ("Info", "ostrel-gateway", "ok")),
    ("<300>1 2025-01-22T19:57:11.113Z host - - ID7 - ok", ("Error", "", "ok")),
    ("[2025-03-16 11:58:58.914] [I] [sabrent.invoice] kept", ("Info", "sabrent.invoice", "kept")),
    ("2025-04-05 18:30:50.066  ERROR 93790 --- [scheduler-1] t.q.SchedulerService           : Could not", ("Error", "t.q.SchedulerService", "Could not")),
    ("2025-03-05 01:40:32.481  \x1b[35mINFO\x1b[0m 62217 --- [main] t.f.Repo   : x\r", ("Info", "t.f.Repo", "x")),
    ("2025/04/12 20:02:31 [crit] 7023#65: *8011 Replica", ("Error", "", "*8011 Replica")),
    ("2025-02-24 00:40:06,032 - bramwick.index - CRITICAL - beat", ("Error", "bramwick.index", "beat")),
    ("WARNING:pellamy.index.job:Slow answer", ("Warning", "pellamy.index.job", "Slow answer")),
    ("2025-03-12T15:38:52.245Z lurvane-worker: Release", ("Unknown", "lurvane-worker", "Release")),
    ("2025-03-16T11:54:50.013Z\t852c082b-5108-3c36-e5b8-a273f9cccedc\tERR\tHeap", ("Error", "", "Heap")),
    ('192.0.2.118 - k [16/Mar/2025:11:56:03 +0000] "GET /x?q=error HTTP/1.1" 429 59691', ("Warning", "", '"GET /x?q=error HTTP/1.1" 429 59691')),
    ("ValueError: bad row", None),
    ("Caused by: test.IoFailure: reset", None),
    ("goroutine 442 [running]:", None),
    ("    > 2025-01-28 10:00:00 ERROR copied", None),
    ("", None),
    (None, None),
]


def layouts_of(lines):
    tree = TemplateTree()
    for x in lines:
        tree.learn(x)
    return Layouts(h for t in tree.templates() if (h := header_of(t.tokens)))


@pytest.mark.parametrize("line, want", CASES)
def test_headers(line, want):
    got = layouts_of(x for x, _ in CASES).parse(line)
    assert (got and (got.severity, got.component, got.message)) == want


@pytest.mark.parametrize(
    "line, want",
    [
        ("2025/03/01 10:00:00 | WARN | billing.Worker | paid late", ("2025/03/01 10:00:00", "Warning", "billing.Worker", "paid late")),
        ("ERROR 2025-03-01T10:00:00Z [billing] lost 3 rows", ("2025-03-01T10:00:00Z", "Error", "billing", "lost 3 rows")),
        ("Mar  1 10:00:00 web7 sshd[411]: session opened", ("Mar  1 10:00:00", "Unknown", "sshd", "session opened")),
        ("2025-03-01 10:00:00,123 [main] DEBUG # a.b # ready", ("2025-03-01 10:00:00,123", "Debug", "a.b", "ready")),
    ],
)
def test_layouts_that_no_rule_names(line, want):
    assert tuple(layouts_of([line]).parse(line)) == want


def test_templates_merge():
    tree = TemplateTree()
    for verb, what in (("Release", "done"), ("Release", "late"), ("Backup", "done")):
        for i in range(50):
            tree.learn(f"2025-03-12T15:38:52.245Z WARN w{i}: {verb} of node {i} {what}")
    (template,) = tree.templates()
    assert template.tokens == ["<ISO>", "<LEVEL>", "<NAME>:", "<*>", "=of", "=node", "<NUM>", "<*>"] and template.lines == 150 and template.merges == 2
    tree.learn("2025-03-12T15:38:52.245Z WARN [w]: Release of node 1 done")  # another structure is another template
    tree.learn("2025-03-12T15:38:52.245Z WARN w: Release of node 1 done again")  # and so is another number of tokens
    assert sum(1 for _ in tree.templates()) == 3


def test_one_tree_over_partitions(spark):
    lines = [(f"2025-03-12T15:38:52.245Z INFO {w}: {w} took {i} ms",) for i in range(40) for w in ("alpha", "beta", "gamma", "delta")]
    (row,) = learn_templates(spark.createDataFrame(lines, "raw string").repartition(8)).collect()
    assert row.tokens == ["<ISO>", "<LEVEL>", "<NAME>:", "<*>", "=took", "<NUM>", "=ms"] and row.lines == 160 and row.merges > 0


def brute(rows):
    layouts, out, file_, open_ = layouts_of(r[3] for r in rows), {}, None, None
    for line_id, f, _, raw in sorted(rows, key=lambda r: (r[1], r[2])):
        if f != file_:
            file_, open_ = f, None
        h = layouts.parse(raw)
        if h:
            open_ = line_id
            out[line_id] = [1, h.severity, h.component]
        elif open_ is not None:
            out[open_][0] += 1
    return {(k, *v) for k, v in out.items()}


def test_entries_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(chunks, "FANOUT", 2)
    rng = random.Random(5)
    lines = [c for c, _ in CASES if c is not None]
    rows = [(i, 7 if i < 2000 else i % 9, i, rng.choice(lines)) for i in range(3000)]
    rows += [(10_000 + i, 50, i, "  goes on") for i in range(300)] + [(20_000 + i, 51, i, "2025-03-12T15:38:52.245Z a: x" if i == 0 else "\tat x") for i in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "line_id bigint, file_id bigint, line_no bigint, raw string").repartition(5)
        got = {tuple(r) for r in entries_of_lines(df).select("line_id", "n_lines", "severity", "component").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(rows)


def test_edges(spark):
    schema = "line_id bigint, file_id bigint, line_no bigint, raw string"
    good = "2025-03-12T15:38:52.245Z a: x"
    rows = [(1, 1, 1, good), (1, 1, 1, good), (2, 1, 2, None), (3, None, 1, good), (4, 2, None, good), (5, 3, 1, "z" * 200_000), (6, 3, 2, good + "y" * 200_000)]
    df = spark.createDataFrame(rows, schema).withColumn("key", F.lit(9)).withColumn("chunk", F.lit("c"))
    got = sorted((r.line_id, r.n_lines) for r in entries_of_lines(df).collect())
    assert got == [(1, 2), (6, 1)]
    assert entries_of_lines(spark.createDataFrame([], schema)).count() == 0
