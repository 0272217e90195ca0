"""Queries of the general data-pipeline problems: p2 (instants), p5 (fields of lines), p6 (rows that fail to load)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.fields import entries_of_lines
from tidelog.operators.instants import certain_instants
from tidelog.operators.loading import bad_rows, file_counts
from tidelog.session import prepare, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return certain_instants(table(spark, sf_dir, "entries"), table(spark, sf_dir, "log_sources"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return entries_of_lines(table(spark, sf_dir, "raw_lines")).select("line_id", "n_lines", "severity", "component")


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return entries_of_lines(table(spark, sf_dir, "raw_lines"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bad_rows(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "parse_stats"))


def p6_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    counts = file_counts(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "parse_stats"))
    return counts.withColumn("off_by", F.col("parse_errors") - F.col("n_bad"))


QUERIES = {f.__name__: f for f in (p2_found, p5_found, p5_entries, p6_found, p6_file_counts)}

# The quoting rules as one pattern; the file's delimiter is replaced by the control character 1 before.
_FIELD = '("(?:[^"]|"")*"|[^"\x01]*)'
_ROW = "^" + "\x01".join([_FIELD] * 8) + "$"
_SHAPE = '^(?:"(?:[^"]|"")*"|[^"\x01]*)(?:\x01(?:"(?:[^"]|"")*"|[^"\x01]*))*$'


def _field(i: int) -> str:
    raw = f"regexp_extract(x, '{_ROW}', {i})"
    return f"CASE WHEN {raw} LIKE '\"%' THEN replace({raw}[2:-2], '\"\"', '\"') ELSE {raw} END"


_STRICT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$"
_CHECKED = f"""
        WITH d AS (SELECT file_id, min(delimiter) AS delimiter FROM parse_stats WHERE kind = 'rows' AND length(delimiter) = 1 GROUP BY 1),
        r AS (SELECT row_id, file_id, replace(coalesce(raw, ''), coalesce(delimiter, ','), chr(1)) AS x FROM raw_rows LEFT JOIN d USING (file_id)),
        q AS (SELECT *, regexp_matches(x, '{_SHAPE}') AS sound, regexp_matches(x, '{_ROW}') AS eight FROM r),
        f AS (SELECT *, {', '.join(f"{_field(i)} AS f{i}" for i in (1, 2, 3, 5, 7))} FROM q),
        v AS (SELECT row_id, file_id, CASE WHEN NOT sound THEN 'quoting' WHEN NOT eight THEN 'column_count'
            WHEN NOT regexp_matches(f1, '{_STRICT}') OR TRY_CAST(substr(f1, 1, 10) AS DATE) IS NULL OR substr(f1, 12, 2) > '23' OR substr(f1, 15, 2) > '59' OR substr(f1, 18, 2) > '59'
              OR lower(f2) NOT IN ('error', 'warning', 'info', 'debug', 'trace', 'unknown') OR f3 = ''
              OR (f5 <> '' AND (NOT regexp_matches(f5, '^[0-9]+$') OR TRY_CAST(f5 AS HUGEINT) > 4294967295))
              OR (f7 <> '' AND NOT regexp_matches(f7, '^[0-9]+([.][0-9]+)?$')) THEN 'invalid_value' END AS reason FROM f)
"""
ORACLES: dict[str, str] = {
    "p6_found": f"{_CHECKED} SELECT row_id, reason FROM v WHERE reason IS NOT NULL",
    "p6_file_counts": f"""{_CHECKED}, c AS (SELECT file_id, count(*) AS n_rows, count(reason) AS n_bad, count(*) FILTER (reason = 'quoting') AS n_quoting,
        count(*) FILTER (reason = 'column_count') AS n_column_count, count(*) FILTER (reason = 'invalid_value') AS n_invalid_value FROM v GROUP BY file_id),
        s AS (SELECT file_id, max(parse_errors) AS parse_errors FROM parse_stats WHERE kind = 'rows' GROUP BY file_id)
        SELECT *, parse_errors - n_bad AS off_by FROM c LEFT JOIN s USING (file_id)""",
}
