"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, scaled


def quotas(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Blocks per period for each source, at least one, summing to ``period``
    (largest remainders; the period grows to hold one block of each): a rounded
    table for callers of ``pfair_period``. ``mix`` goes by the exact weights."""
    names = sorted(k for k, w in weights.items() if w > 0)
    if not names:
        return {}
    period, total = max(period, len(names)), sum(weights[k] for k in names)
    exact = {k: weights[k] / total * period for k in names}
    out = {k: max(1, int(exact[k])) for k in names}
    while (gap := period - sum(out.values())) != 0:
        step = 1 if gap > 0 else -1
        free = [k for k in names if out[k] + step >= 1]
        for k in sorted(free, key=lambda k: (-(exact[k] - out[k]) * step, k))[: abs(gap)]:
            out[k] += step
    return out


def pfair(weights: Mapping[str, float], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, k, release, deadline, slot) of each of ``blocks``, by slot.

    Block k of a source with share w of all weights is released at floor(k/w)
    and due at ceil((k+1)/w), k counted from the start and w taken as the exact
    fraction, so nothing is rounded that could add up; of the released blocks
    the one due first takes each slot. A fluid schedule meets all windows, so
    earliest deadline first does, and a source is less than one block from its
    share for as long as it lasts. Where no block is released, slots stay empty.
    """
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    part = {s: int(w * unit) for s, w in exact.items()}
    whole = sum(part.values())
    window = lambda s, k: (k * whole // part[s], -(-(k + 1) * whole // part[s]))
    waiting = [(*window(s, 0), s, 0) for s in part if blocks.get(s, 0) > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            r, d, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (d, s, k, r))
        d, s, k, r = heapq.heappop(ready)
        yield s, k, r, d, slot
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (*window(s, k + 1), s, k + 1))


def pfair_period(quota: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """``pfair`` over one period of whole quotas: it fills the period exactly, so
    the schedule repeats."""
    return list(pfair(quota, quota))


def schedule_table(spark: SparkSession, weights: Mapping[str, float], blocks: Mapping[str, int], chunk: int) -> DataFrame:
    """The whole schedule, ``chunk`` blocks of one source a row: ``p_skey,
    p_chunk, p_release, p_deadline, p_slot`` (arrays by block; 24 bytes each)."""
    cols: dict[str, tuple[array, array, array]] = {s: (array("q"), array("q"), array("q")) for s in blocks}
    for s, _, *at in pfair(weights, blocks):
        for c, x in zip(cols[s], at, strict=True):
            c.append(x)
    cuts = [(s, k) for s in blocks for k in range(0, blocks[s], chunk)]
    listed = [pa.array([np.frombuffer(cols[s][j], np.int64)[k : k + chunk] for s, k in cuts], pa.list_(pa.int64())) for j in range(3)]
    keys = [pa.array([s for s, _ in cuts], pa.string()), pa.array([k // chunk for _, k in cuts], pa.int64())]
    return spark.createDataFrame(pa.Table.from_arrays([*keys, *listed], ["p_skey", "p_chunk", "p_release", "p_deadline", "p_slot"]))


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    alpha: float = 0.5,
    period: int = 1024,
    block_bytes: int = 1 << 16,
    per_bucket: int = 200,
    most_blocks: int = 1 << 21,
) -> DataFrame:
    """``row`` (struct of the ``carry`` columns; None: all), ``size, block,
    release, deadline, slot, bucket, in_bucket``; reading by ``slot`` interleaves
    the sources at their target weights.

    A block is ``block_bytes`` of one source: rows are laid end to end (a row's
    size is its UTF-8 bytes plus 1) and a row belongs to the block it starts in,
    so long texts take as many turns as they are worth. Default targets are
    ``size ** alpha``; a source missing in ``weights`` gets that rule too, scaled to the
    rest. While every source lasts, each is within one block of its share; a
    source that ends leaves its slots empty and the others keep their ratio.
    No row is dropped or repeated.

    Sizes are summed by (source, hash bucket); a row's offset is its bucket's
    start plus a running sum inside the bucket, so a source with any share of
    the rows is spread over many tasks. The schedule follows the exact weights
    over all blocks: the driver makes and broadcasts 24 bytes a block,
    ``period`` blocks of a source in a row. Blocks grow with the input so that
    there are ``most_blocks`` and one a source at most (50 MB and a few seconds
    at the default): above 128 GiB a block is the total over ``most_blocks``,
    and every source stays within one such block of its share.

    Nulls: a null source is a source of its own, a null text has size 1, a null
    id is ordered first. Columns of any name travel inside ``row``.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")
    n = scaled(docs.count(), per_bucket, 16, 1 << 16)
    bucket = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("mix")), F.lit(n)).cast("int")
    rows = docs.select(F.struct(*(F.col(quoted(c)).alias(c) for c in (docs.columns if carry is None else carry))).alias("row"), F.col(id_col).alias("_id"), key.alias("_skey"), bucket.alias("_bucket"), size.alias("_size"), F.xxhash64(text_col).alias("_tie"))
    sums = rows.groupBy("_skey", "_bucket").agg(F.sum("_size").alias("_sum"))
    starts = sums.select("_skey", "_bucket", (F.sum("_sum").over(Window.partitionBy("_skey").orderBy("_bucket")) - F.col("_sum")).alias("_start"))
    totals = {r[0]: r[1] for r in sums.groupBy("_skey").agg(F.sum("_sum")).collect()}  # a row per source
    rule = {s: float(t) ** alpha for s, t in totals.items()}
    if weights is not None:
        named = {("null" if s is None else f"={s}"): w for s, w in weights.items()}
        scale = sum(named.values()) / (sum(rule[s] for s in named if s in rule) or 1)
        rule = {s: named.get(s, rule[s] * scale) for s in totals}
        if any(rule[s] <= 0 for s in rule):
            raise ValueError("a source that has rows needs a weight above 0")
    block_bytes = max(block_bytes, -(-sum(totals.values()) // most_blocks))
    table = schedule_table(spark, rule, {s: (t - 1) // block_bytes + 1 for s, t in totals.items()}, period)
    order = Window.partitionBy("_skey", "_bucket").orderBy("_id", "_size", "_tie")
    run = rows.withColumn("_run", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    run = run.join(starts.select(F.col("_skey").alias("b_skey"), F.col("_bucket").alias("b_bucket"), "_start"), (F.col("_skey") == F.col("b_skey")) & (F.col("_bucket") == F.col("b_bucket")))
    run = run.withColumn("_block", F.floor((F.col("_start") + F.col("_run")) / F.lit(block_bytes)))
    run = run.join(F.broadcast(table), (F.col("_skey") == F.col("p_skey")) & (F.floor(F.col("_block") / F.lit(period)) == F.col("p_chunk")))
    at = [F.get(f"p_{x}", F.pmod(F.col("_block"), F.lit(period)).cast("int")).alias(x) for x in ("release", "deadline", "slot")]
    return run.select("row", F.col("_size").alias("size"), F.col("_block").alias("block"), *at, F.col("_bucket").alias("bucket"), F.col("_run").alias("in_bucket"))


def mixed_order(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` in the order of the mix, with its own columns."""
    return mix(docs, **kw).orderBy("slot", "bucket", "in_bucket").select("row.*")
