"""Queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.garbled import restored_fields
from tidelog.llm.near_duplicates import long_texts, similar_groups, similar_pairs
from tidelog.llm.packing import fill, packed
from tidelog.llm.personal import personal_data, redacted_entries
from tidelog.llm.reading import reading_bands
from tidelog.llm.repeats import collapsed_events, repeated_events
from tidelog.llm.tokens import token_ids
from tidelog.session import prepare, table


P1_THRESHOLD, P1_LEAST_WORDS = 0.7, 60


def _p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    entries = long_texts(table(spark, sf_dir, "entries"), "entry", "entry_id", "message", P1_LEAST_WORDS)
    return entries.unionByName(long_texts(table(spark, sf_dir, "error_groups"), "group", "group_no", "pattern", P1_LEAST_WORDS))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(_p1_texts(spark, sf_dir), P1_THRESHOLD)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(_p1_texts(spark, sf_dir), P1_THRESHOLD)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return repeated_events(table(spark, sf_dir, "entries"))


def p3_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return collapsed_events(table(spark, sf_dir, "entries"), table(spark, sf_dir, "log_sources"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return personal_data(table(spark, sf_dir, "entries"), table(spark, sf_dir, "person_names"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    df = redacted_entries(table(spark, sf_dir, "entries"), table(spark, sf_dir, "person_names"))
    return df.select("entry_id", "message", "raw", F.to_json("extra").alias("extra"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return restored_fields(table(spark, sf_dir, "entries")).select("entry_id", "field", "restorable")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return restored_fields(table(spark, sf_dir, "entries"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_ids(table(spark, sf_dir, "documents"))


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(p9_packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return reading_bands(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_collapsed, p4_found, p4_redacted, p7_found, p7_restored, p8_ids, p9_packed, p9_fill, p10_found)}
