"""The registered queries and the SQL that states each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


def tidy(df: DataFrame) -> DataFrame:
    """Integers as longs and floats as doubles, so that results compare by value."""
    return df.select(*[F.col(c).cast(_WIDER[t]).alias(c) if t in _WIDER else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its name, with its SQL if any."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return run

    return add
