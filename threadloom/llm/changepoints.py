"""Penalised change points: memoised depth-first branch-and-bound over segmentations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Series up to this length get their costs as one matrix, longer ones a column at a time.
_MATRIX = 1024
#: A cached key is cost * 2^21 + segments * 2 + 1; a bound of an open subproblem is even.
_SHIFT = 21
_FAR = np.int64(1) << 62


def _costs(p, q, starts, ends) -> np.ndarray:
    """Costs of the segments ``[starts, ends)`` from prefix sums of the values and
    of their squares: exact integers, ``n * floor(1000 * ln(V))``."""
    n = np.maximum(ends - starts, 1)
    s, squares = p[ends] - p[starts], q[ends] - q[starts]
    if p.dtype == object:
        v = 1 + (n.astype(object) * squares - s * s) // (n.astype(object) ** 2)
        logs = np.frompyfunc(math.log, 1, 1)(np.maximum(v, 1)).astype(np.float64)
    else:
        logs = np.log(np.maximum(1 + (n * squares - s * s) // (n * n), 1).astype(np.float64))
    return n * np.floor(1000 * logs).astype(np.int64)


def _bounds(p, q, least: int, penalty: int) -> np.ndarray:
    """For every prefix a cost that no segmentation of it falls below.

    A segment's squared error never falls when it grows, and ``n * g(error / n)``
    with the concave ``g`` below (never above ``floor(1000 * ln(V))``) of a
    segment is at least the sum over disjoint parts of it. Blocks of ``least``
    days hold one cut at most, so a block costs the least of: whole, or a
    penalty and its two parts. Days after the last whole block are bounded by
    ``g(0)`` each."""
    p, q = p.astype(np.float64), q.astype(np.float64)
    g = lambda x: 1000 * np.where(x >= 1, np.log(np.maximum(x, 1)), x - 1) - 1
    days, blocks = len(p) - 1, (len(p) - 1) // least
    at = np.arange(blocks) * least

    def part(a, b):
        n = b - a
        return n * g(np.maximum(q[b] - q[a] - (p[b] - p[a]) ** 2 / n, 0) / n)

    low = part(at, at + least)
    for j in range(1, least):
        low = np.minimum(low, penalty + part(at, at + j) + part(at + j, at + least))
    total = np.concatenate([[0.0], np.cumsum(low)])
    s = np.arange(days + 1)
    out = total[s // least] - 1001 * (s % least)
    return np.maximum(np.floor(out - 1e-9 * np.abs(out)).astype(np.int64) - 1, 0)


def best_segments(values: np.ndarray, least: int = 5, penalty: int = 10_000) -> tuple[list[int], int]:
    """Starts of the best segmentation of whole numbers, ascending, and its cost
    with penalties. Of equal costs the one with the fewest segments wins, then
    the earliest starts, compared from the last segment backwards.

    ``solve(end)`` needs the best of all prefixes before it; it asks for them
    from the series' end, depth first with a stack of its own, the open start
    with the smallest bound first, and stops when every open start's bound is
    above the incumbent (an equal one is still solved: it may win the tie).
    Solved ends are cached by keys that order as (cost, segments), so the first
    smallest key is the earliest start."""
    n = len(values)
    if n < 2 * least:
        p, q = _sums(values)
        return [0], int(_costs(p, q, np.array([0]), np.array([n]))[0])
    p, q = _sums(values)
    key = np.empty(n + 1, np.int64)
    key[:] = _bounds(p, q, least, penalty) << _SHIFT
    key[1:least] = _FAR  # no prefix shorter than a segment
    key[0] = (-penalty << _SHIFT) + 1
    every = np.arange(n + 1)
    steps = ((_costs(p, q, every[None, :], every[:, None]) + penalty) << _SHIFT) + 2 if n <= _MATRIX else None
    came = [0] * (n + 1)
    stack = [n]
    while stack:
        end = stack[-1]
        last = end - least + 1
        step = steps[end, :last] if steps is not None else ((_costs(p, q, every[:last], np.full(last, end)) + penalty) << _SHIFT) + 2
        all_keys = step + key[:last]
        at = int(all_keys.argmin())
        if key[at] & 1:  # solved, and every open start's bound is above it
            key[end], came[end] = all_keys[at], at
            stack.pop()
        else:
            stack.append(at)
    starts, end = [], n
    while end:
        end = came[end]
        starts.append(end)
    return starts[::-1], int(key[n] >> _SHIFT)


def _sums(values) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values and squares; Python integers where 64 bits may not
    hold ``n`` times the sum of squares."""
    top = max(abs(int(values.max())), abs(int(values.min())))
    kind = np.int64 if (len(values) * top) ** 2 < 1 << 62 else object
    x = values.astype(kind)
    zero = np.zeros(1, kind)
    return np.concatenate([zero, np.cumsum(x)]), np.concatenate([zero, np.cumsum(x * x)])


_OUT = ("segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost")


def _segmented(least: int, penalty: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, out = [], {c: [] for c in _OUT}
            series = b.column("series")
            flat = series.flatten()
            days, totals = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = np.cumsum(series.value_lengths().to_numpy(zero_copy_only=False))
            for i, (a, z) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
                first = int(days[a:z].min())
                values = np.zeros(int(days[a:z].max()) - first + 1, np.int64)
                values[days[a:z] - first] = totals[a:z]
                starts, best = best_segments(values, least, penalty)
                s = np.array(starts)
                e = np.append(s[1:], len(values))
                p, q = _sums(values)
                at += [i] * len(s)
                n = e - s
                out["segment_no"] += range(1, len(s) + 1)
                out["first_day"] += (first + s).tolist()
                out["n_days"] += n.tolist()
                out["total"] += [int(p[y] - p[x]) for x, y in zip(starts, e)]
                out["spread"] += [1 + (int(y - x) * int(q[y] - q[x]) - int(p[y] - p[x]) ** 2) // int(y - x) ** 2 for x, y in zip(starts, e)]
                out["cost"] += _costs(p, q, s, e).tolist()
                out["n_segments"] += [len(s)] * len(s)
                out["best_cost"] += [best] * len(s)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), *[pa.array(out[c], pa.int64()) for c in _OUT]], ["key", *_OUT])

    return run


def change_points(rows: DataFrame, key: str = "vendor_id", day: Column | None = None, value: str = "quantity", least: int = 5, penalty: int = 10_000) -> DataFrame:
    """One row per segment of every key's daily series: ``key, segment_no,
    first_day, n_days, total, spread, cost, n_segments, best_cost`` (longs;
    ``first_day`` in days since 1970).

    A key's series is the sum of ``value`` (whole numbers) per ``day`` (a date,
    by default that of ``shipped_at``) from its first to its last day, days
    between without rows count 0. ``cost`` of a segment is ``n * floor(1000 *
    ln(V))`` with ``V = 1 + floor((n * Q - S * S) / (n * n))`` (``spread``);
    the segmentation into segments of ``least`` days or more minimises the sum
    of costs plus ``penalty`` for every cut. Shorter series are one segment.

    Sums combine on the map side by key and day, so a hot key is as many rows as
    it has days; then a key's days meet in one group, and only days with rows
    travel. A kernel holds one series at a time: its length is the days it spans,
    whatever the number of rows. No step sees more than one key.

    Rows without a value or a day don't count; a null key is a key of its own;
    repeated rows count as often as they are there; other columns are ignored.
    An empty table has no segments.
    """
    day = F.to_date("shipped_at") if day is None else day
    daily = (
        rows.select(F.col(key).alias("key"), F.unix_date(day).alias("day"), F.col(value).cast("bigint").alias("value"))
        .where(F.col("value").isNotNull() & F.col("day").isNotNull())
        .groupBy("key", "day")
        .agg(F.sum("value").alias("total"))
    )
    series = daily.groupBy("key").agg(F.collect_list(F.struct("day", "total")).alias("series"))
    kind = series.schema["key"].dataType.simpleString()
    return series.mapInArrow(_segmented(least, penalty), f"key {kind}, " + ", ".join(f"{c} bigint" for c in _OUT)).withColumnRenamed("key", key)
