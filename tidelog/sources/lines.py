"""Sources of lines S1-S8: files, folders, standard input, tables; (source, line_no, line).

Line numbers order lines but have gaps: the scan gives running numbers, which keep the order of the splits without
reading a file in one task.  The numbers of one call are unique over all of its sources.
"""

from __future__ import annotations

import itertools
import sys
import time
import uuid
from functools import reduce
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import shared_dir

STDIN = "-"
#: Lines of standard input that the driver holds at a time.
STDIN_LINES = 100_000


def _scan(spark: SparkSession, paths: list[str], glob: str | None, tolerant: bool) -> DataFrame:
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "false")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("source"))


def _numbered(lines: DataFrame) -> DataFrame:
    return lines.select("source", F.monotonically_increasing_id().alias("line_no"), "line")


def _text(df: DataFrame, lossy: bool) -> DataFrame:
    text = F.make_valid_utf8("value") if lossy else F.validate_utf8("value")
    return df.select("source", F.regexp_replace(text, r"\r$", "").alias("line"))


def read_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None, lossy: bool = True, tolerant: bool = False) -> DataFrame:
    """Lines of files; a line end of CR LF loses the CR, invalid UTF-8 becomes replacement characters.

    With ``lossy=False`` invalid UTF-8 raises when the lines are read.
    """
    return _numbered(_text(_scan(spark, [paths] if isinstance(paths, str) else list(paths), glob, tolerant), lossy))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder whose extension is log, not of folders in it; unreadable files are passed over."""
    return read_lines(spark, folder, glob="*.log", tolerant=True)


def read_stdin(spark: SparkSession) -> DataFrame:
    """S3: standard input to its end; it is spooled to a file in the shared folder, never held as a whole."""
    return _numbered(_spooled(spark))


def _spooled(spark: SparkSession) -> DataFrame:
    folder = f"{shared_dir(spark)}/stdin-{uuid.uuid4().hex}"
    while block := list(itertools.islice(sys.stdin, STDIN_LINES)):
        rows = [(line.rstrip("\n").removesuffix("\r"),) for line in block]
        spark.createDataFrame(rows, "line STRING").coalesce(1).write.mode("append").parquet(f"{folder}/{time.time_ns():020d}")
    parts = sorted(str(p.getPath()) for p in _status(spark, folder))
    if not parts:
        return spark.createDataFrame([], "source STRING, line STRING")
    out = reduce(DataFrame.unionByName, (spark.read.parquet(p) for p in parts))
    return out.select(F.lit(STDIN).alias("source"), "line")


def _status(spark: SparkSession, folder: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(fs.listStatus(path)) if fs.exists(path) else []


def union_sources(spark: SparkSession, names: list[str], lossy: bool = True) -> DataFrame:
    """Lines of several sources, one after the other; ``-`` is standard input, a name without extension a folder.

    They are numbered after the union, hence each number occurs once and the numbers follow the order of the names.
    """
    one = lambda n: _spooled(spark) if n == STDIN else _text(_scan(spark, [n], *((None, False) if PurePath(n).suffix else ("*.log", True))), lossy)
    return _numbered(reduce(DataFrame.unionByName, map(one, names)))
