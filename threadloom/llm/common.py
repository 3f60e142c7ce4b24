"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: ASCII white space, as the word definition has it.
SPACES = r"[\x09-\x0D\x20]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would touch other alphabets, but is
    faster: it serves texts of ASCII alone)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def quoted(name: str) -> str:
    """A column's name so that dots and back ticks in it count as such."""
    return "`" + name.replace("`", "``") + "`"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: a column used inside a
    lambda would otherwise be evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: the cluster's checkpoint folder. Where
    none is configured, a local master gets a temporary one of our own (tests);
    on a cluster that is an error, as executors don't share their disks."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="threadloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


class _Scopes(threading.local):
    """Paths written inside each open ``scratch`` of a thread, innermost last."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete what was written at ``path``."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the
    lineage, survives lost executors, and later reads prune columns. The table
    goes with the ``scratch`` it is cut in, or else with the application."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/threadloom-{spark.sparkContext.applicationId}"
    path = f"{top}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _files(spark, top)
    fs.deleteOnExit(at)
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what was ``cut`` inside at the end, but tables handed to the
    function it yields; those belong to the next outer ``scratch``. What is
    returned may only read such tables."""
    made: list[str] = []
    kept: list[str] = []
    _SCOPES.open.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(p for p in made if any(p.rsplit("/", 1)[1] in f for f in df.inputFiles()))
        return df

    try:
        yield keep
    finally:
        _SCOPES.open.pop()
        for path in set(made) - set(kept):
            remove(spark, path)
        if _SCOPES.open:
            _SCOPES.open[-1].extend(kept)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table built inside the JVM from one JSON literal."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{','.join(':'.join(c.strip().split()) for c in schema.split(','))}>>")))


def scaled(rows: int, per: int, least: int, most: int) -> int:
    """How many buckets keep about ``per`` rows each, within bounds."""
    return max(least, min(most, -(-rows // per)))
