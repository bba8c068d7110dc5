"""Facts written once and read by everything that builds on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a new temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        ctx = spark.sparkContext
        if ctx._jsc.sc().getCheckpointDir().isEmpty():
            if not ctx.master.startswith("local[") and ctx.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            ctx.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
        folder = ctx._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; what is written there goes when the driver's JVM ends."""
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, folder = _file_system(spark, at)
    fs.deleteOnExit(folder)
    return at


#: Tables of this process: by application, time zone, hash of the plan and state of the input files, the plans
#: and where their rows lie.
_WRITTEN: dict[tuple, list[tuple[DataFrame, str]]] = {}


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _key(df: DataFrame) -> tuple | None:
    """None for a plan that reads no files: its rows may differ each time."""
    spark, states = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        fs, at = _file_system(spark, name)
        status = fs.getFileStatus(at)
        states.append((name, status.getLen(), status.getModificationTime()))
    return (spark.sparkContext.applicationId, spark.conf.get("spark.sql.session.timeZone"), df.semanticHash(), tuple(states)) if states else None


def stored(df: DataFrame, name: str = "facts", path: str | None = None) -> DataFrame:
    """df as a table: branches that build on it read it instead of computing it again.

    Without a path it lies in the shared folder and goes when the driver's JVM ends; the same plan over
    the same files is written once in an application. A plan that reads no files is written each time.
    """
    spark = df.sparkSession
    key = _key(df) if path is None else None
    for plan, at in _WRITTEN.get(key, []):
        fs, done = _file_system(spark, f"{at}/_SUCCESS")
        if plan.sameSemantics(df) and fs.exists(done):
            return spark.read.schema(df.schema).parquet(at)
    at = path or scratch(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(at)
    if key:
        _WRITTEN.setdefault(key, []).append((df, at))
    return spark.read.schema(df.schema).parquet(at)
