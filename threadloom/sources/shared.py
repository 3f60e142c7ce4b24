"""The folder that all executors share, for what is written between stages."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The configured checkpoint folder. Without one a local master gets a
    temporary folder of its own; on a cluster, whose executors don't share their
    disks, that is an error. Work is done the same way in both cases. This module
    needs a classic session, as it reaches the context behind it."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="threadloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    # what keep() wrote is removed once no DataFrame reads it any more
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return named.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: cuts the lineage of an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed at the end of the application."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Clears the shuffles of a write once it is done; they otherwise stay until the
#: driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: as ``keep``, but in columns
    and compressed, and its shuffles go at once. Rows keep no order and no
    partitions. ``release`` removes it; else it goes with the application."""
    spark = df.sparkSession
    path, before = new_path(spark), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes what ``stored`` returned; nothing may read it any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
