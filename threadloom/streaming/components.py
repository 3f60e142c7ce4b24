"""Component statistics kept up to date: items join, move and leave.

A component (a cluster, a mixture's part) has a count and a sum of the vectors of
its items. Items are held as state, so that an item that leaves is taken out with
the vector it came with. A large component is dealt to ``salts`` states by item;
their sums are added at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from threadloom.sources.shared import new_path

PARTIAL = "component long, salt long, version long, n long, sums array<double>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Members(StatefulProcessor):
    """State of one (component, salt): its items with their vectors, and their sum.

    Of an item's changes the one of highest ``at`` holds, whatever the order in
    which they come; at equal ``at`` a removal holds, and joins carry the same
    vector. A repeated or older change
    has no effect. A removed item stays as a mark without a vector, so that a
    late older change doesn't bring it back. With ``span`` (``at`` in
    milliseconds of event time) items and marks end ``span`` after their ``at``:
    a timer for each ``step`` of time takes out what is due.
    """

    def __init__(self, span: int | None = None, step: int = 60_000) -> None:
        self.span, self.step = span, step

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "item long", "at long, vec array<double>")
        self.total = handle.getValueState("total", "version long, n long, sums array<double>")
        self.due = handle.getMapState("due", "due long", "items array<long>") if self.span else None

    def _load(self) -> tuple[int, int, np.ndarray | None]:
        if not self.total.exists():
            return 0, 0, None
        version, n, sums = self.total.get()
        return version, n, np.array(sums, float) if len(sums) else None  # only removals so far

    def _store(self, key: tuple, version: int, n: int, sums: np.ndarray | None) -> Iterator[pd.DataFrame]:
        sums = np.zeros(0) if sums is None else sums if n else np.zeros_like(sums)  # an empty component keeps no rounding
        self.total.update((version + 1, n, sums.tolist()))
        yield pd.DataFrame({"component": [key[0]], "salt": [key[1]], "version": [version + 1], "n": [n], "sums": [sums.tolist()]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, n, sums = self._load()
        passed = timerValues.getCurrentWatermarkInMs() if self.span else None
        due: dict[int, list[int]] = {}
        changed = False
        for batch in rows:
            last = batch.sort_values(["item", "at", "gone"]).drop_duplicates("item", keep="last")
            for item, at, gone, vec in zip(last["item"].tolist(), last["at"].tolist(), last["gone"].tolist(), last["vec"], strict=True):
                ends = -(-(at + self.span) // self.step) * self.step if self.span else None
                if ends is not None and ends <= passed:
                    continue
                old = self.held.getValue((item,)) if self.held.containsKey((item,)) else None
                if old is not None and (old[0] > at or old[0] == at and (old[1] is None or not gone)):
                    continue
                vec = None if gone else np.array(vec, float)
                if old is not None and old[1] is not None:
                    n, sums = n - 1, sums - np.array(old[1], float)
                if vec is not None:
                    n, sums = n + 1, vec if sums is None else sums + vec
                self.held.updateValue((item,), (at, None if vec is None else vec.tolist()))
                changed = True
                if ends is not None:
                    due.setdefault(ends, []).append(item)
        for ends, items in due.items():
            if self.due.containsKey((ends,)):
                items = [*self.due.getValue((ends,))[0], *items]
            else:
                self.handle.registerTimer(ends)
            self.due.updateValue((ends,), (items,))
        if changed:
            yield from self._store(key, version, n, sums)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends = expiredTimerInfo.getExpiryTimeInMs()
        version, n, sums = self._load()
        for item in set(self.due.getValue((ends,))[0]):
            if not self.held.containsKey((item,)):
                continue
            at, vec = self.held.getValue((item,))
            if at + self.span > ends:
                continue
            if vec is not None:
                n, sums = n - 1, sums - np.array(vec, float)
            self.held.removeKey((item,))
        self.due.removeKey((ends,))
        yield from self._store(key, version, n, sums)

    def close(self) -> None:
        pass


def salt(item: str | Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(salts)).cast("long")


def component_sums(changes: DataFrame, salts: int = 32, span: int | None = None, step: int = 60_000) -> DataFrame:
    """The partial sums (``PARTIAL``) of each state that a batch of ``changes``
    touched. ``changes`` is a stream of ``component, item, at`` (long), ``gone``
    (boolean), ``vec``; with ``span`` it has a watermark, and ``at`` is the
    watermarked time in milliseconds."""
    keyed = changes.where("component is not null and item is not null and at is not null and (gone or vec is not null)").withColumn("salt", salt("item", salts))
    return keyed.groupBy("component", "salt").transformWithStateInPandas(Members(span, step), PARTIAL, "Update", "EventTime" if span else "None")


def latest(partials: DataFrame) -> DataFrame:
    """``component, n, mean`` from all partial sums written so far: the latest of
    each state, added up. Components without items are left out."""
    last = partials.groupBy("component", "salt").agg(F.max_by(F.struct("n", "sums"), "version").alias("s")).where("s.n > 0")
    n = last.groupBy("component").agg(F.sum("s.n").alias("n"))
    cells = last.select("component", F.posexplode("s.sums").alias("i", "x")).groupBy("component", "i").agg(F.sum("x").alias("x"))
    means = cells.join(n, "component").groupBy("component", "n")
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("x")))), lambda t: t["x"]).alias("mean"))


def replay(spark: SparkSession, changes: DataFrame, batches: int = 3, salts: int = 32) -> DataFrame:
    """``latest`` of a table of changes fed as a stream of about ``batches``
    batches. The files, the partial sums and the stream's log lie in the shared
    folder; a batch that runs again overwrites its own part. The session's state
    store is put back afterwards."""
    source, sums, log = (new_path(spark) for _ in range(3))
    changes.write.parquet(source)
    files = len(spark.read.parquet(source).inputFiles())
    if not files:
        return spark.createDataFrame([], "component long, n long, mean array<double>")
    spark.createDataFrame([], PARTIAL).write.parquet(f"{sums}/batch=-1")
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", math.ceil(files / batches)).parquet(source)
        out = component_sums(stream, salts).writeStream.outputMode("update").option("checkpointLocation", log)
        out.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{sums}/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return latest(spark.read.option("basePath", sums).schema(PARTIAL).parquet(sums))
