"""Session helpers: settings the operators rely on, and lineage cuts that survive lost executors."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every query sets for itself, as the caller owns the session.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true"}
#: Static setting that a session should be built with: without it the client takes a stack trace for each expression,
#: which costs as much as to analyse the plan.
NO_DEBUGGING = ("spark.python.sql.dataFrameDebugging.enabled", "false")
#: Checkpoints are deleted once nothing refers to them any more; read by the context at each checkpoint.
CLEANING = "spark.cleaner.referenceTracking.cleanCheckpoints"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tidelog_shipped", False):
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    out = os.path.join(tempfile.mkdtemp(prefix="tidelog-code-"), "tidelog_code.zip")
    Path(out).write_bytes(data.getvalue())
    sc.addPyFile(out)
    sc._tidelog_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the code and apply the settings results depend on: UTC session zone, last-wins duplicate JSON keys."""
    ship(spark)
    spark.sparkContext._jsc.sc().conf().set(CLEANING, "true")
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only where it is unset (a local session in tests) a
    folder of this machine is used.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    Used where a later stage would evaluate ``df`` more than once (range sampling, iteration).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores of the session, if it is one small file or so; else as it is.

    A table of a few splits leaves most cores idle in front of costly expressions.  Only tables of up to ``SPREAD_BYTES``
    are shuffled for it; larger ones have splits enough.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if estimated_bytes(df) <= SPREAD_BYTES else df


def estimated_bytes(df: DataFrame) -> int:
    """The plan's own estimate of its size; no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Size of the files up to which a table is spread over all cores.
SPREAD_BYTES = 256 << 20

#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 50_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it to be small; else as it is, for a shuffled join.

    For sides of short rows with one row a key, joined with tables in which one key may hold a third of all rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
