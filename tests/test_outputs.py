"""Sources, reports, configuration, enrichment and streams."""

import io
import json
import os
import sys
import threading
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidelog.cli import log, main, set_up_logging
from tidelog.formats.records import _record
from tidelog.formats.registry import FORMATS, register
from tidelog.operators import cache
from tidelog.operators.enrich import MockProvider, NoProvider, Progress, enrich, with_retries
from tidelog.operators.providers import provider_of
from tidelog.plans.pipeline import parse_lines
from tidelog.sinks import reports
from tidelog.sources.config import ParserConfig, ProviderChoice, read_toml
from tidelog.sources.lines import read_folder, read_lines, read_stdin
from tidelog.streaming.watch import pattern_counts, stitched_batches, watch_lines, windowed_counts

LOG = "2024-01-01T00:00:00Z ERROR down: Exception\r\n\tat a.B.c(D.java:1)\r\n2024-01-01T00:00:05Z WARN slow\r\n2024-01-01T00:00:06Z INFO fine\r\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(LOG.encode())
    (tmp_path / "in" / "b.txt").write_bytes(b"ERROR no")
    (tmp_path / "in" / "c.log").write_bytes(b"ERROR bad \xff byte\n")
    return tmp_path


def test_sources(spark, folder):
    rows = read_folder(spark, str(folder / "in")).collect()
    assert len(rows) == 5 and any("�" in r.line for r in rows) and not any(r.line.endswith("\r") for r in rows)
    with pytest.raises(Exception, match="(?i)utf"):
        read_lines(spark, str(folder / "in" / "c.log"), lossy=False).collect()


@pytest.mark.parametrize("fmt", ["json", "terminal", "html"])
def test_command_line(spark, folder, fmt, capsys):
    target = folder / "out" / f"r.{fmt}"
    assert main(["investigate", str(folder / "in" / "a.log"), "--format", fmt, "--output", str(target)]) == 0
    text = target.read_text()
    if fmt == "json":
        groups = json.loads(text)
        assert [(g["severity"], g["cnt"]) for g in groups] == [("Error", 1), ("Warning", 1)]
    else:
        assert "down: Exception" in text and "slow" in text and "fine" not in text
    assert main(["investigate", str(folder / "in" / "a.log"), "--severity", "warn", "--format", "terminal"]) == 0
    assert "down" not in capsys.readouterr().out


def test_reports_escape_and_limit():
    group = {"severity": "Error", "pattern": "<b>", "cnt": 2, "first_seen": None, "last_seen": datetime(2024, 1, 1), "entries": [{"ts": None, "raw": "Jan 1 x", "message": "<i>"}]}
    page = "".join(reports.html_parts([group], 1, 2))
    assert "&lt;b&gt;" in page and "<time>Jan 1</time>" in page and "<b>" not in page
    assert "2 times: <b>" in reports.terminal([group], 1, 2, datetime(2024, 1, 2, tzinfo=timezone.utc))
    assert reports.pick_format("json", "terminal") == "json" and reports.pick_format("html", "terminal") == "terminal" and reports.pick_format(None, None) == "html"


def test_config(tmp_path):
    path = tmp_path / "p.toml"
    path.write_text("chunk_size = 0\nmultiline_timeout_ms = 7\n")
    config = ParserConfig.load(str(path))
    assert config.multiline_timeout_ms == 7 and config.problems() == ["chunk_size must be positive"] and ParserConfig.load(None) == ParserConfig()
    assert ProviderChoice.pick("OpenAI", {"providers": {"openai": {"model": "m"}}}, {"OPENAI_API_KEY": "k"}) == ProviderChoice("openai", "m", "k", None)
    with pytest.raises(ValueError, match="unknown provider"):
        ProviderChoice.pick("x", {}, {})


class Failing:
    name = "failing"

    def analyze(self, prompt):
        raise RuntimeError("401 unauthorized" if "first" in prompt else "connection reset")


def test_enrichment(spark):
    prompts = spark.createDataFrame([("g1", "Pattern: first"), ("g2", "Pattern: b")], "group_id string, prompt string")
    got = {r.group_id: r for r in enrich(prompts, MockProvider(), 2).collect()}
    assert got["g1"].analysis.explanation == "about first" and got["g1"].attempts == 1 and got["g1"].analysis.suggestions == []
    failed = {r.group_id: (r.analysis, r.attempts) for r in enrich(prompts, Failing(), 2, retries=1, initial_ms=1, max_ms=1).collect()}
    assert failed == {"g1": (None, 1), "g2": (None, 2)}
    assert enrich(prompts, NoProvider(), 1).first().analysis.explanation.startswith("AI analysis not enabled")
    with pytest.raises(ValueError, match="concurrency"):
        enrich(prompts, NoProvider(), 0)
    assert with_retries(lambda: "x", 0, 1, 1) == ("x", 1, None)


def test_streams_agree_with_batch(spark, folder):
    lines = watch_lines(spark, str(folder / "in"))
    q = pattern_counts(lines).writeStream.outputMode("complete").format("memory").queryName("t1").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = pattern_counts(read_lines(spark, str(folder / "in")).select("line"))
    assert sorted(map(tuple, spark.table("t1").collect())) == sorted(map(tuple, batch.collect()))
    q = windowed_counts(lines).writeStream.outputMode("complete").format("memory").queryName("t2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("t2").agg(F.sum("cnt")).first()[0] == 2
    seen = []
    q = stitched_batches(spark, str(folder / "in"), str(folder / "cp"), lambda df, n: seen.extend(r.n_lines for r in df.collect()))
    q.awaitTermination()
    assert sorted(seen) == [1, 1, 1, 1, 2]


def test_several_files_and_all_entries(spark, tmp_path, capsys):
    """Each file's lines are numbered anew by its scan; groups must not take each other's examples, nor lose entries."""
    for name, what in (("a", "disk"), ("b", "net")):
        (tmp_path / f"{name}.log").write_text("".join(f"2024-01-01T00:00:{i % 60:02d}Z ERROR {what} failed\n" for i in range(120)))
    assert main(["investigate", str(tmp_path / "a.log"), str(tmp_path / "b.log"), "--format", "json"]) == 0
    groups = json.loads(capsys.readouterr().out)
    assert {(g["cnt"], len(g["entries"]), g["example_message"].split()[2]) for g in groups} == {(120, 120, "disk"), (120, 120, "net")}
    assert all(e["message"].split()[2] == g["example_message"].split()[2] for g in groups for e in g["entries"])
    assert main(["investigate", str(tmp_path / "a.log"), "--format", "html", "--output", str(tmp_path / "r.html")]) == 0
    assert (tmp_path / "r.html").read_text().count("<li><time>") == 120
    assert main(["investigate", str(tmp_path / "a.log"), "--format", "terminal"]) == 0
    assert "from 2024-01-01 00:00:00 to 2024-01-01 00:00:59" in capsys.readouterr().out


def test_explanations_come_from_the_cache(spark, tmp_path, capsys):
    (tmp_path / "a.log").write_text("2024-01-01T00:00:00Z ERROR disk failed\n")
    command = ["investigate", str(tmp_path / "a.log"), "--format", "json", "--ai", "--provider", "mock", "--cache", str(tmp_path / "cache")]
    for _ in range(2):
        assert main(command) == 0
        (group,) = json.loads(capsys.readouterr().out)
        assert group["analysis"]["explanation"].startswith("about ")
    rows = cache.read(spark, str(tmp_path / "cache")).collect()
    assert [(r.provider, r.explanation) for r in rows] == [("mock", group["analysis"]["explanation"])]


def test_config_command(tmp_path, capsys):
    path = str(tmp_path / "c.toml")
    for key, value in (("providers.openai.api_key", "secret"), ("output.format", "json"), ("chunk_size", "5"), ("providers.openai.model", "m")):
        assert main(["config", path, key, value]) == 0
    assert main(["config", path, "chunk_size"]) == 0 and main(["config", path]) == 0
    out = capsys.readouterr().out
    assert out.startswith("5\n") and 'format = "json"' in out and "secret" not in out
    assert ParserConfig.load(path).chunk_size == 5 and ProviderChoice.pick("openai", read_toml(path), {}).key == "secret"


def test_clean_command(tmp_path, monkeypatch, capsys):
    for i in range(4):
        (tmp_path / f"{i}.html").write_text("x")
        os.utime(tmp_path / f"{i}.html", (i, i))
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert main(["clean", str(tmp_path)]) == 0 and len(list(tmp_path.iterdir())) == 4
    assert main(["clean", str(tmp_path), "--keep", "1", "--force"]) == 0 and [p.name for p in tmp_path.iterdir()] == ["3.html"]


def test_settings_reach_the_entries(spark):
    lines = spark.createDataFrame([("s", 1, "03/02/2024 10:00:00 ERROR x [w-1] at a.B.c(D.java:7) tenant=acme")], "source string, line_no bigint, line string")
    config = ParserConfig(custom_timestamp_formats=["%d/%m/%Y %H:%M:%S"], custom_metadata_patterns={"tenant": r"tenant=(\w+)"})
    row = parse_lines(lines, config=config).first()
    assert (row.thread, row.function, row.file, row.file_line, row.extra["tenant"]) == ("w-1", "a.B.c", "D.java", 7, "acme")
    with pytest.warns(UserWarning, match="unknown format"):
        parse_lines(lines, "nonsense")


def test_own_format(spark):
    class Piped:
        name, multiline, confidence = "piped", False, 0.8

        def can_parse(self, line):
            return line.rlike(r"^\w+\|")

        def record(self, line, year):
            return _record(line, severity=F.initcap(F.substring_index(line, "|", 1)), message=F.substring_index(line, "|", -1))

    register(Piped())
    try:
        lines = spark.createDataFrame([("s", 1, "error|disk"), ("s", 2, "info|ok")], "source string, line_no bigint, line string")
        assert sorted((r.format, r.severity, r.message) for r in parse_lines(lines, columns=("severity", "message")).withColumn("format", F.lit("piped")).collect()) == [("piped", "Error", "disk"), ("piped", "Info", "ok")]
    finally:
        del FORMATS["piped"]


@pytest.mark.parametrize(
    "name, answer",
    [
        ("openai", {"choices": [{"message": {"content": "hi"}}]}), ("claude", {"content": [{"text": "hi"}]}),
        ("gemini", {"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}), ("ollama", {"response": "hi"}),
    ],
)
def test_remote_providers(name, answer):
    seen = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))), dict(self.headers)))
            status, body = (200, answer) if len(seen) == 1 else (429, {})
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = provider_of(ProviderChoice(name, "m", "key", f"http://127.0.0.1:{server.server_port}"))
        assert provider.analyze("why?") == "hi" and "why?" in json.dumps(seen[0][1])
        assert name == "ollama" or any("key" in v for v in seen[0][2].values())
        assert with_retries(lambda: provider.analyze("again"), 1, 1, 1)[1] == 2  # 429 is worth another try
    finally:
        server.shutdown()
    with pytest.raises(ValueError, match="no key"):
        provider_of(ProviderChoice("openai"))


def test_progress_and_logging(spark, tmp_path, capsys):
    progress = Progress(spark.sparkContext, 4, sys.stderr)
    progress.done.add(1)
    assert progress.line(2.0) == "1/4 (25 %), 6 s left\n"
    set_up_logging(False, str(tmp_path / "logs" / "x.log"))
    log.info("kept")
    log.warning("seen")
    assert "seen" in capsys.readouterr().err and "INFO kept" in (tmp_path / "logs" / "x.log").read_text()


def test_watch_command(spark, folder, capsys):
    assert main(["watch", str(folder / "in"), "--once"]) == 0
    assert "down: Exception" in capsys.readouterr().out


def test_standard_input(spark, monkeypatch):
    monkeypatch.setattr(sys, "stdin", io.StringIO("a\r\nb\n"))
    monkeypatch.setattr("tidelog.sources.lines.STDIN_LINES", 1)
    assert [(r.source, r.line) for r in read_stdin(spark).orderBy("line_no").collect()] == [("-", "a"), ("-", "b")]
