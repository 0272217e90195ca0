"""DuckDB statements that check queries of this subpackage; the others are tested against brute force in tests/llm."""

from __future__ import annotations

# The message pattern, stated again for the check.
PATTERN = (
    r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}|"
    r"\d{2}\s+\w{3}\s+\d{4}\s+\d{2}:\d{2}:\d{2},\d{3}|\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|"
    r"\b[A-Za-z0-9+/]{20,}={0,2}#\d+\b|\b\d{5,}\b|\b0x[0-9a-fA-F]+\b|\bWorker\d+\b|https?://[^\s]+|\b\d+\.\d+\.\d+\.\d+\b|"
    r"/[\w/.-]+:\d+|\[[\w-]+-\d+\]|\bexec-\d+\b"
)
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"

_PAIRS = f"""t AS (SELECT 'entry' AS record_kind, entry_id AS id, {_WORDS.format('message')} AS w FROM entries
            UNION ALL SELECT 'group', group_no, {_WORDS.format('pattern')} FROM error_groups),
        l AS (SELECT * FROM t WHERE len(w) >= 60),
        q AS (SELECT a.record_kind, a.id AS id_a, b.id AS id_b FROM l a JOIN l b ON a.record_kind = b.record_kind AND a.id < b.id
        WHERE len(list_intersect(a.w, b.w)) * 10 >= 7 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_PAIRS} SELECT * FROM q",
    "p1_groups": f"""
        WITH RECURSIVE {_PAIRS}, e AS (SELECT record_kind, id_a AS a, id_b AS b FROM q UNION ALL SELECT record_kind, id_b, id_a FROM q),
        r AS (SELECT record_kind, id, id AS other FROM l UNION SELECT r.record_kind, r.id, e.b FROM r JOIN e ON r.record_kind = e.record_kind AND r.other = e.a),
        g AS (SELECT record_kind, id, min(other) AS group_id FROM r GROUP BY ALL), n AS (SELECT record_kind, a AS id, count(*) AS n_links FROM e GROUP BY ALL),
        c AS (SELECT record_kind, id, min(id) OVER (PARTITION BY record_kind, list_sort(w)) AS class_id FROM l)
        SELECT record_kind, id, class_id, group_id, coalesce(n_links, 0) AS n_links FROM c JOIN g USING (record_kind, id) LEFT JOIN n USING (record_kind, id)""",
    "p3_found": f"""
        WITH o AS (SELECT file_id, entry_no, message, row_number() OVER (PARTITION BY file_id, entry_no ORDER BY entry_id) AS copy FROM entries),
        k AS (SELECT file_id, entry_no, coalesce(regexp_replace(lower(regexp_replace(message, '{PATTERN}', '<DYNAMIC>', 'g')), '[^a-z]', '', 'g'), '#' || CAST(entry_no AS VARCHAR)) AS event FROM o WHERE copy = 1),
        s AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY entry_no) - row_number() OVER (PARTITION BY file_id, event ORDER BY entry_no) AS part FROM k)
        SELECT file_id, min(entry_no) AS first_no, max(entry_no) AS last_no, count(*) AS n_events FROM s GROUP BY file_id, event, part HAVING count(*) >= 3""",
}
