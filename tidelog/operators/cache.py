"""The table of earlier analyses: lookup S9, upsert Z6, expiry F6.  A row's key is (pattern, provider, model)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schema import CACHE

KEY = ("pattern", "provider", "model")
VERSION = "version-"
SUGGESTIONS = "ARRAY<STRUCT<description: STRING, code_example: STRING, priority: SMALLINT>>"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a cache folder; empty if there is none."""
    versions = sorted(_names(spark, folder))
    return spark.read.schema(CACHE).parquet(f"{folder}/{versions[-1]}") if versions else spark.createDataFrame([], CACHE)


def write(cache: DataFrame, folder: str) -> None:
    """A new version beside the old one, which readers may still be at; the last but one is removed."""
    spark = cache.sparkSession
    cache.write.parquet(f"{folder}/{VERSION}{time.time_ns():020d}")
    for name in sorted(_names(spark, folder))[:-2]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Whole versions: those that a finished job has marked."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return [n for n in found if n.startswith(VERSION) and done(n)]


def lookup(groups: DataFrame, cache: DataFrame, provider: str, model: str) -> DataFrame:
    """Groups with explanation, root_cause and suggestions of the cache, null on a miss; bad JSON has no suggestions.

    A cache has one row a key, as :func:`upsert` leaves it.
    """
    hit = cache.where((F.col("provider") == provider) & (F.col("model") == model)).select(
        "pattern", "explanation", "root_cause",
        F.coalesce(F.from_json("suggestions", SUGGESTIONS), F.array().cast("array<struct<description:string,code_example:string,priority:smallint>>")).alias("suggestions"),
    )
    return groups.join(hit, "pattern", "left")


def misses(groups: DataFrame, cache: DataFrame, provider: str, model: str) -> DataFrame:
    """Groups that the cache lacks."""
    have = cache.where((F.col("provider") == provider) & (F.col("model") == model)).select("pattern")
    return groups.join(have, "pattern", "left_anti")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the rows of ``new`` in place of those of the same key; write it to a new folder.

    Of several new rows of one key the latest ``created_at`` counts, then the greatest texts.
    """
    own = [c for c in new.columns if c not in KEY]
    order = F.struct(*(F.col(c) for c in sorted(own, key=lambda c: c != "created_at")))
    new = new.groupBy(*KEY).agg(F.max(order).alias("_tl_row")).select(*(F.col(c) if c in KEY else F.col(f"_tl_row.{c}") for c in new.columns))
    return cache.join(new.select(*KEY), list(KEY), "left_anti").select(*new.columns).unionByName(new)


def expire(cache: DataFrame, now_s: int, days: int) -> DataFrame:
    """rows that are at most so many days old."""
    return cache.where(F.col("created_at") >= now_s - days * 86_400)
