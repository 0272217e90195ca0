"""Sinks Z1-Z5: terminal, JSON and HTML reports, and files of many groups.

Reports are written piece by piece from an iterator of groups, each with an iterator of all of its entries: none is left
out, and none of them all is held at a time.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame

from tidelog.functions.severity import LABELS

RULE = "=" * 72


def pick_format(argument: str | None, configured: str | None) -> str:
    """An explicit format other than html wins; else the configured one; else html."""
    return argument if argument and argument != "html" else (configured or "html")


def _ago(then: datetime | None, now: datetime) -> str:
    if then is None:
        return "unknown"
    s = int((now - then.replace(tzinfo=then.tzinfo or timezone.utc)).total_seconds())
    for unit, size, end in (("seconds", 1, 60), ("minutes", 60, 3600), ("hours", 3600, 86400)):
        if s < end:
            return f"{s // size} {unit} ago"
    return f"{s // 86400} days ago"


def terminal(groups: Iterable[dict], total_groups: int, total_entries: int, now: datetime, time_range: tuple | None = None) -> str:
    """The report as text; ``groups`` are the rows to show."""
    out = ["", "Log report", RULE, f"{total_groups} patterns in {total_entries} entries"]
    if time_range and all(time_range):
        out.append("from " + " to ".join(f"{t:%Y-%m-%d %H:%M:%S}" for t in time_range) + " UTC")
    for g in groups:
        label, icon = LABELS[g["severity"]]
        out += [RULE, f"{icon} {label}, {g['cnt']} times: {g['pattern']}", f"  first {_ago(g['first_seen'], now)}, last {_ago(g['last_seen'], now)}"]
        if g.get("example_message"):
            line = g.get("example_line")
            where = f" ({g['example_file']}" + (f":{line}" if line is not None else "") + ")" if g.get("example_file") else ""
            out.append(f"  for example: {g['example_message']}{where}")
        analysis = g.get("analysis")
        if analysis:
            out.append(f"  explanation: {analysis['explanation']}")
            if analysis.get("root_cause"):
                out.append(f"  root cause: {analysis['root_cause']}")
            out += [f"  {i}. {s['description']}" for i, s in enumerate(analysis.get("suggestions") or [], 1)]
    return "\n".join([*out, RULE]) + "\n"


def json_parts(groups: Iterable[dict]) -> Iterator[str]:
    """An array of groups with all of their entries, in parts."""
    text = lambda x: json.dumps(x, default=str, ensure_ascii=False)
    yield "["
    for i, g in enumerate(groups):
        yield ("," if i else "") + "\n  " + text({k: v for k, v in g.items() if k != "entries"})[:-1] + ', "entries": ['
        for j, e in enumerate(g.get("entries") or ()):
            yield ("," if j else "") + "\n    " + text(e)
        yield "]}"
    yield "\n]\n"


def write_json(groups: DataFrame, path: str) -> None:
    """Z2 at scale: JSON lines, written by the executors."""
    groups.write.mode("overwrite").json(path)


_PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Log report</title><style>
body{{font:15px sans-serif;margin:2rem auto;max-width:70rem}}.card{{border:1px solid #ccc;border-radius:6px;padding:1rem;margin:1rem 0}}
.high{{color:#b00}}.medium{{color:#a60}}pre{{white-space:pre-wrap}}</style></head><body><h1>Log report</h1>
<p class="stats">{patterns} patterns, {entries} occurrences{span}</p><input id="q" placeholder="Search" aria-label="Search">
"""
_SCRIPT = """<script>document.getElementById('q').oninput=e=>{const v=e.target.value.toLowerCase();for(const c of
document.querySelectorAll('.card'))c.hidden=!c.textContent.toLowerCase().includes(v)}</script></body></html>
"""


def _priority(p: int | None) -> str:
    return "high" if p and 1 <= p <= 3 else "medium" if p and 4 <= p <= 6 else ""


def _shown_time(entry: dict) -> str:
    """T8."""
    if entry["ts"] is not None:
        return f"{entry['ts']:%Y-%m-%d %H:%M:%S} UTC"
    words = (entry["raw"] or "").split()
    return " ".join(words[:2]) if len(words) > 1 else "No timestamp"


def _analysis(analysis: dict) -> Iterator[str]:
    yield f"<p>{html.escape(analysis['explanation'] or '')}</p>"
    if analysis.get("root_cause"):
        yield f"<p>Root cause: {html.escape(analysis['root_cause'])}</p>"
    fixes = analysis.get("suggestions") or []
    code = lambda s: f"<pre>{html.escape(s['code_example'])}</pre>" if s.get("code_example") else ""
    yield "<ol>" + "".join(f'<li class="{_priority(s.get("priority"))}">{html.escape(s["description"] or "")}{code(s)}</li>' for s in fixes) + "</ol>"
    links = analysis.get("related_resources") or []
    if links:
        yield "<ul>" + "".join(f'<li><a href="{html.escape(r["url"] or "")}">{html.escape(r["title"] or "")}</a></li>' for r in links) + "</ul>"


def html_parts(groups: Iterable[dict], total_groups: int, total_entries: int, time_range: tuple | None = None) -> Iterator[str]:
    """Z3: searchable cards with all entries, in parts; every text is escaped."""
    span = " from " + " to ".join(f"{t:%Y-%m-%d %H:%M:%S}" for t in time_range) if time_range and all(time_range) else ""
    yield _PAGE.format(patterns=total_groups, entries=total_entries, span=span)
    for g in groups:
        label, icon = LABELS[g["severity"]]
        times = " - ".join(f"{g[k]:%Y-%m-%d %H:%M:%S}" for k in ("first_seen", "last_seen") if g.get(k))
        yield f'<section class="card"><h2>{icon} {html.escape(label)}: {html.escape(g["pattern"])}</h2><p>{g["cnt"]} occurrences {times}</p>'
        yield from _analysis(g["analysis"]) if g.get("analysis") else ()
        yield "<ol>"
        for e in g.get("entries") or ():
            yield f"<li><time>{html.escape(_shown_time(e))}</time> <pre>{html.escape(e['message'] or '')}</pre></li>"
        yield "</ol></section>\n"
    yield _SCRIPT


def write_parts(parts: Iterable[str], path: str) -> None:
    """A report to a file, part by part; folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(parts)


def report_name(now: datetime, stem: str = "logs") -> str:
    return f"{stem}-report-{now:%Y%m%d-%H%M%S}.html"


def clean(folder: str, pattern: str, keep: int = 0) -> list[str]:
    """Remove files of a folder by pattern but the newest ``keep``; the names that went."""
    doomed = to_clean(folder, pattern, keep)
    for p in doomed:
        p.unlink()
    return [p.name for p in doomed]


def to_clean(folder: str, pattern: str, keep: int = 0) -> list[Path]:
    """The files that :func:`clean` removes, newest first."""
    found = (p for p in Path(folder).glob(pattern) if p.is_file())
    return sorted(found, key=lambda p: (p.stat().st_mtime, p.name), reverse=True)[keep:]
