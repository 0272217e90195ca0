"""Record layouts (lines, entries, groups, analysis, cache) and severity ranks."""

from __future__ import annotations

LINES = "source STRING, line_no BIGINT, line STRING"
ENTRIES = (
    "source STRING, entry_no BIGINT, format STRING, ts TIMESTAMP, severity STRING, message STRING, file STRING, "
    "line BIGINT, function STRING, thread STRING, extra MAP<STRING,STRING>, raw STRING"
)
GROUPS = (
    "group_id STRING, pattern STRING, cnt BIGINT, first_seen TIMESTAMP, last_seen TIMESTAMP, severity STRING, "
    "example_message STRING, example_file STRING, example_line BIGINT"
)
ANALYSIS = (
    "explanation STRING, root_cause STRING, "
    "suggestions ARRAY<STRUCT<description: STRING, code_example: STRING, priority: SMALLINT>>, "
    "related_resources ARRAY<STRUCT<title: STRING, url: STRING, source: STRING>>, "
    "tool_invocations ARRAY<STRUCT<tool: STRING, status: STRING, duration_ms: BIGINT, contributed_to: ARRAY<STRING>>>"
)
CACHE = (
    "pattern STRING, provider STRING, model STRING, explanation STRING, root_cause STRING, suggestions STRING, "
    "created_at BIGINT"
)
CALLS = (
    "call_id BIGINT, cached BOOLEAN, success BOOLEAN, duration_ms BIGINT, attempts INT, failure_reason STRING"
)

#: The six severity labels; the position is the code used inside aggregates.
SEVERITIES = ("Error", "Warning", "Info", "Debug", "Trace", "Unknown")
