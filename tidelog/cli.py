"""Command line: ``python -m tidelog.cli investigate app.log --format json``; also ``watch``, ``config`` and ``clean``."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import chain, groupby
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.responses import prompt
from tidelog.functions.severity import rank
from tidelog.operators import cache as stored
from tidelog.operators.enrich import CONCURRENCY, Progress, enrich
from tidelog.operators.grouping import entries_of, group_entries, ranked, time_range, top_examples, totals, with_examples
from tidelog.operators.providers import provider_of
from tidelog.plans.pipeline import parse_lines
from tidelog.session import NO_DEBUGGING, cut, prepare
from tidelog.sinks import reports
from tidelog.sources.config import ParserConfig, ProviderChoice, get_setting, read_toml, set_setting, shown
from tidelog.sources.lines import union_sources
from tidelog.streaming.watch import pattern_counts, watch_lines

log = logging.getLogger("tidelog")


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--log-file", help="log there as well, in full")
    commands = p.add_subparsers(dest="command", required=True)
    i = commands.add_parser("investigate")
    i.add_argument("files", nargs="*", default=["-"])
    i.add_argument("--log-format", default=None)
    i.add_argument("--no-multiline", action="store_true")
    i.add_argument("--severity", choices=("error", "warn", "info"))
    i.add_argument("--limit", type=int, default=0, help="groups to show, 0 for all")
    i.add_argument("--format", choices=("terminal", "json", "html"))
    i.add_argument("--output")
    i.add_argument("--config")
    i.add_argument("--ai", action="store_true", help="explain the groups")
    i.add_argument("--provider")
    i.add_argument("--no-cache", action="store_true")
    i.add_argument("--cache", help="folder of earlier explanations")
    i.add_argument("--concurrency", type=int, default=CONCURRENCY)
    w = commands.add_parser("watch")
    w.add_argument("folder")
    w.add_argument("--log-format", default="plain")
    w.add_argument("--once", action="store_true", help="stop when all files that are there are read")
    c = commands.add_parser("config")
    c.add_argument("path")
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    d = commands.add_parser("clean")
    d.add_argument("folder")
    d.add_argument("--pattern", default="*.html")
    d.add_argument("--keep", type=int, default=0)
    d.add_argument("--force", action="store_true", help="don't ask")
    return p


def set_up_logging(verbose: bool, path: str | None) -> None:
    """Warnings to the console, or all with ``verbose``; everything to a file if one is named."""
    log.handlers.clear()
    log.setLevel(logging.DEBUG)
    console = logging.StreamHandler(sys.stderr)
    console.setLevel(logging.DEBUG if verbose else logging.WARNING)
    log.addHandler(console)
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        kept = logging.FileHandler(path, encoding="utf-8")
        kept.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(kept)


def explained(groups: DataFrame, entries: DataFrame, a: argparse.Namespace, settings: dict) -> DataFrame:
    """Groups with ``analysis``: from the cache, else from the provider, whose answers go to the cache."""
    choice = ProviderChoice.pick(a.provider, settings)
    provider = provider_of(choice)
    model = getattr(provider, "model", provider.name)
    spark, folder = groups.sparkSession, None if a.no_cache else a.cache
    known = stored.read(spark, folder) if folder else None
    todo = groups if known is None else stored.misses(groups, known, choice.name, model)
    asked = todo.join(top_examples(entries), "group_id")
    prompts = asked.select("group_id", prompt(F.col("pattern"), F.col("cnt"), F.col("severity"), F.col("examples")).alias("prompt"))
    progress = Progress(spark.sparkContext, prompts.count(), sys.stderr)
    ended = progress.watch()
    calls = cut(enrich(prompts, provider, a.concurrency, progress=progress))
    ended.set()
    for r in calls.where("failure_reason IS NOT NULL").select("failure_reason").limit(5).collect():
        log.warning("no explanation: %s", r[0])
    out = groups.join(calls.select("group_id", "analysis"), "group_id", "left")
    if folder:
        answers = out.where("analysis IS NOT NULL")
        new = answers.select(
            "pattern", F.lit(choice.name).alias("provider"), F.lit(model).alias("model"), "analysis.explanation", "analysis.root_cause",
            F.to_json("analysis.suggestions").alias("suggestions"), F.lit(int(time.time())).cast("bigint").alias("created_at"),
        )
        stored.write(stored.upsert(known, new) if known is not None else new, folder)
    if known is not None:
        hit = stored.lookup(groups.select("pattern"), known, choice.name, model).where("explanation IS NOT NULL")
        kind = out.schema["analysis"].dataType.simpleString()
        cached = hit.select("pattern", F.from_json(F.to_json(F.struct("explanation", "root_cause", "suggestions")), kind).alias("cached"))
        out = out.join(cached, "pattern", "left").withColumn("analysis", F.coalesce("analysis", "cached")).drop("cached")
    return cut(out)


def _rows(groups: DataFrame, entries: DataFrame | None, level: str | None) -> Iterator[dict]:
    """Ranked groups as they come from the executors, one partition at a time, each with an iterator of its entries."""
    order = (rank(F.col("severity")), F.desc("cnt"), F.col("pattern"))
    if entries is None:
        yield from (r.asDict(recursive=True) for r in groups.orderBy(*order).toLocalIterator())
        return
    own = entries_of(groups, entries, level)
    entry = F.struct("ts", F.col("own_severity").alias("severity"), "message", "file", "file_line", "raw")
    both = groups.join(own.withColumnRenamed("severity", "own_severity"), "group_id").select(*groups.columns, "occurrence", entry.alias("entry"))
    found = (r.asDict(recursive=True) for r in both.orderBy(*order, "occurrence").toLocalIterator())
    for _, members in groupby(found, key=lambda r: r["group_id"]):
        first = next(members)
        yield {**{c: first[c] for c in groups.columns}, "entries": (r["entry"] for r in chain((first,), members))}


def investigate(a: argparse.Namespace, spark: SparkSession) -> int:
    settings, now = read_toml(a.config), datetime.now(timezone.utc)
    config = ParserConfig.load(a.config)
    if wrong := config.problems():
        log.error("; ".join(wrong))
        return 2
    fmt = a.log_format or (config.default_format if config.default_format or config.auto_detect else "plain") or "auto"
    multiline = config.enable_multiline and not a.no_multiline
    lines = union_sources(spark, a.files, lossy=config.utf8_recovery)
    # numbers are unique over all files, hence entries need no source to be told apart
    entries = cut(parse_lines(lines, fmt, multiline, now.year, config=config).drop("source"))
    groups = cut(group_entries(entries, now.strftime("%Y-%m-%d %H:%M:%S"), a.severity))
    n_groups, n_entries = totals(groups).first()
    log.info("%d groups of %d entries", n_groups, n_entries)
    if not n_groups:
        print("No errors or warnings found.")
        return 0
    chosen = with_examples(cut(ranked(groups, a.limit)), entries)
    if a.ai:
        chosen = explained(chosen, entries, a, settings)
    span = tuple(time_range(entries, a.severity).first())
    kind = reports.pick_format(a.format, settings.get("output", {}).get("format"))
    rows = _rows(chosen, None if kind == "terminal" else entries, a.severity)
    if kind == "json":
        parts = reports.json_parts(rows)
    elif kind == "html":
        parts = reports.html_parts(rows, n_groups, n_entries, span)
    else:
        parts = iter([reports.terminal(rows, n_groups, n_entries, now, span)])
    target = a.output or (f"reports/{reports.report_name(now)}" if kind == "html" else None)
    if target:
        reports.write_parts(parts, target)
        print(target)
    else:
        sys.stdout.writelines(parts)
    return 0


def watch(a: argparse.Namespace, spark: SparkSession) -> int:
    """Counts by pattern, printed whenever files have arrived."""

    def show(batch: DataFrame, n: int) -> None:
        print(f"-- batch {n}")
        for r in batch.orderBy(F.desc("cnt"), "pattern").limit(20).collect():
            print(f"{r.cnt:>8}  {r.severity:<8} {r.pattern}")

    writer = pattern_counts(watch_lines(spark, a.folder), a.log_format).writeStream.outputMode("complete").foreachBatch(show)
    (writer.trigger(availableNow=True) if a.once else writer).start().awaitTermination()
    return 0


def configure(a: argparse.Namespace) -> int:
    """All settings, one of them, or a new value for it; keys are never printed."""
    if a.value is not None:
        set_setting(a.path, a.key, a.value)
    elif a.key:
        print(get_setting(a.path, a.key))
    else:
        print(shown(a.path), end="")
    return 0


def clean(a: argparse.Namespace) -> int:
    """Files of a folder, after a question unless forced."""
    doomed = reports.to_clean(a.folder, a.pattern, a.keep)
    if not doomed:
        print("nothing to remove")
        return 0
    if not a.force and input(f"remove {len(doomed)} files of {a.folder}? [y/N] ").strip().lower() not in ("y", "yes"):
        print("kept")
        return 0
    for name in reports.clean(a.folder, a.pattern, a.keep):
        print(name)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    set_up_logging(a.verbose, a.log_file)
    if a.command in ("config", "clean"):
        return {"config": configure, "clean": clean}[a.command](a)
    spark = prepare(SparkSession.builder.appName("tidelog").config(*NO_DEBUGGING).getOrCreate())
    return {"investigate": investigate, "watch": watch}[a.command](a, spark)


if __name__ == "__main__":
    raise SystemExit(main())
