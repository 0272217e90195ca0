"""M1 against a state machine, also where a source spreads over many chunks."""

import random
import re

from tidelog.operators.stitch import CONTINUATIONS, ERROR_START, stitch

LINES = ["ERROR boom", "\tat a.b(C.java:1)", "  indented", "INFO fine", "", "   ", "Caused by: x", "goroutine 5", "at once", "  error inside", "plain"]


def state_machine(lines):
    def goes_on(x):
        return bool(x.strip()) and (any(re.search(p, x) for p in CONTINUATIONS) or x.lstrip().startswith("at ") or x.startswith(("\t", "  ")))

    out, open_, trace = [], None, False
    for n, x in lines:
        if not x.strip():
            if trace:
                open_[1].append(x)
            continue
        if trace and goes_on(x):
            open_[1].append(x)
            continue
        if open_:
            out.append(open_)
        open_, trace = (n, [x]), bool(re.search(ERROR_START, x))
        if not trace:
            out.append(open_)
            open_ = None
    if open_:
        out.append(open_)
    return {(n, "\n".join(x)) for n, x in out}


def test_random_sequences(spark):
    rng = random.Random(3)
    rows = [(f"s{s}", n, rng.choice(LINES)) for s in range(40) for n in range(rng.randint(1, 30))]
    rows += [("hot", n, rng.choice(LINES[:6])) for n in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "source string, line_no bigint, line string")
        got = {(r.source, r.line_no, r.line) for r in stitch(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = set()
    for s in {r[0] for r in rows}:
        want |= {(s, n, x) for n, x in state_machine([(n, x) for t, n, x in rows if t == s])}
    assert got == want


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1, "x"), ("a", None, "x"), ("a", 1, None), ("a", 2, "ok")], "source string, line_no bigint, line string")
    assert [tuple(r) for r in stitch(df).collect()] == [("a", 2, "ok", 1)]
    assert stitch(df.where("false")).count() == 0


def test_one_entry_over_all_chunks(spark):
    rows = [("hot", n, "ERROR down" if n == 0 else f"  at f{n}") for n in range(500)] + [("z", 0, "INFO up"), ("a", 3, "\tat x")]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.source, r.line_no): r for r in stitch(spark.createDataFrame(rows, "source string, line_no bigint, line string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(got) == {("hot", 0), ("z", 0), ("a", 3)}
    assert got["hot", 0].n_lines == 500 and got["hot", 0].line == "\n".join(r[2] for r in rows[:500])
