"""Segmentation: run lengths, landmarks, interval joins and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.numeric import iou

PAIR = "pair_index"


def run_segments(df: DataFrame, value: str, key: str = PAIR, pos: str = "pos", emit_trailing: bool = True) -> DataFrame:
    """Maximal runs of equal values as half-open spans [start, end).

    ``emit_trailing=False`` leaves out a final run of one position, as some
    exporters do (S18 in compatible mode)."""
    w = Window.partitionBy(key).orderBy(pos)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    marked = df.withColumn("_new", F.when(first, 1).otherwise(changed))
    seg = marked.withColumn("_seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    out = seg.groupBy(key, F.col("_seg").alias("seg")).agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.first(value).alias(value))
    if emit_trailing:
        return out
    last = F.max("seg").over(Window.partitionBy(key))
    return out.withColumn("_last", last).where((F.col("seg") < F.col("_last")) | (F.col("end") - F.col("start") > 1)).drop("_last")


def collapse_repeats(df: DataFrame, value: str, key: str = PAIR, pos: str = "pos", drop: object = None) -> DataFrame:
    """Rows whose value differs from the row before (``drop`` left out)."""
    prev = F.lag(value).over(Window.partitionBy(key).orderBy(pos))
    out = df.withColumn("_prev", prev).where(F.col("_prev").isNull() | (F.col("_prev") != F.col(value))).drop("_prev")
    return out if drop is None else out.where(F.col(value) != F.lit(drop))


def landmarks(df: DataFrame, duration: Column, hop: int, key: str = PAIR, pos: str = "pos") -> DataFrame:
    """Cumulative frame landmarks; each unit lasts at least one hop."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.select(key, (F.col(pos) + 1).alias("k"), F.floor(F.sum(F.greatest(duration, F.lit(hop))).over(w) / hop).alias("frame"))
    return df.select(key).distinct().select(key, F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("frame")).unionByName(ends)


def boundaries_to_spans(df: DataFrame, boundary: str = "boundary", key: str = PAIR, pos: str = "pos") -> DataFrame:
    """Each boundary closes the span [previous boundary's position, own
    position + 1); spans after the first overlap by one frame."""
    b = df.where(F.col(boundary) == 1)
    prev = F.lag(pos).over(Window.partitionBy(key).orderBy(pos))
    return b.select(key, F.coalesce(prev, F.lit(0)).alias("start"), (F.col(pos) + 1).alias("end"))


def landmark_spans(df: DataFrame, key: str = PAIR, at: str = "frame") -> DataFrame:
    """Consecutive landmarks as spans."""
    w = Window.partitionBy(key).orderBy(at)
    return df.withColumn("end", F.lead(at).over(w)).where("end is not null").select(key, F.col(at).alias("start"), "end")


def span_landmarks(df: DataFrame, key: str = PAIR) -> DataFrame:
    """W07 backwards: 0 and the end of every span."""
    return df.select(key, F.col("end").alias("frame")).unionByName(df.select(key, F.lit(0).cast("long").alias("frame"))).distinct()


def _bins(start: Column, end: Column, width: int) -> Column:
    """The bins of ``width`` that [start, end) touches, empty spans one."""
    first = F.floor(start / width)
    return F.sequence(first, F.greatest(F.floor((end - 1) / width), first))


def overlapping(left: DataFrame, right: DataFrame, on: tuple[str, str], spans: tuple[str, str, str, str], width: int = 256) -> DataFrame:
    """Rows of both sides with equal keys ``on`` whose half-open ``spans`` (left
    start and end, right start and end) overlap, each pair once.

    An equi-join on key and bin: a key's work follows its overlaps, not the
    product of its spans, and one long key is spread over its bins. A pair that
    shares several bins is taken in the first of them. Column names must differ.
    """
    (lk, rk), (ls, le, rs, re) = on, map(F.col, spans)
    a = left.withColumn("_bin", F.explode(_bins(ls, le, width)))
    b = right.withColumn("_rbin", F.explode(_bins(rs, re, width)))
    first = F.greatest(F.floor(ls / width), F.floor(rs / width))
    return a.join(b, (F.col(lk) == F.col(rk)) & (F.col("_bin") == F.col("_rbin"))).where((ls < re) & (rs < le) & (F.col("_bin") == first)).drop("_bin", "_rbin")


def covered(spans: DataFrame, points: DataFrame, key: str, point_key: str, width: int = 256) -> DataFrame:
    """Spans (``start, end``) with the rows of ``points`` whose ``pos`` they hold:
    an equi-join on key and bin."""
    a = spans.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), width)))
    b = points.withColumn("_pbin", F.floor(F.col("pos") / width))
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    return a.join(b, (a[key] == F.col(point_key)) & (F.col("_bin") == F.col("_pbin"))).where(inside).drop("_bin", "_pbin")


def best_iou(pred: DataFrame, gold: DataFrame, key: str = PAIR) -> DataFrame:
    """For every predicted span the best IoU with a gold span of its pair."""
    g = gold.select(F.col(key).alias("_gk"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    p = pred.select(F.col(key).alias("_pk"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    hit = overlapping(p, g, ("_pk", "_gk"), ("p_start", "p_end", "g_start", "g_end"))
    score = iou(F.col("p_start"), F.col("p_end"), F.col("g_start"), F.col("g_end"))
    best = hit.groupBy(F.col("_pk").alias(key), F.col("p_start").alias("start"), F.col("p_end").alias("end")).agg(F.max(score).alias("iou"))
    return pred.select(key, "start", "end").distinct().join(best, [key, "start", "end"], "left").select(key, "start", "end", F.coalesce("iou", F.lit(0.0)).alias("iou"))


def matched_boundaries(pred: DataFrame, gold: DataFrame, tolerance: int, least_iou: float = 0.5, key: str = PAIR) -> DataFrame:
    """Pairs of spans whose ends lie within ``tolerance`` or whose IoU is
    above ``least_iou``; the last span of each side is left out."""

    def inner(df: DataFrame, p: str) -> DataFrame:
        last = F.max("end").over(Window.partitionBy(key))
        return df.withColumn("_last", last).where("end < _last").select(F.col(key).alias(f"{p}_key"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))

    a, b = inner(pred, "p"), inner(gold, "g")
    near = F.abs(F.col("p_end") - F.col("g_end")) <= tolerance
    over = iou(F.col("p_start"), F.col("p_end"), F.col("g_start"), F.col("g_end")) > least_iou
    # Ends within the tolerance lie in the same bin or in neighbours; spans with
    # an IoU above 0 overlap. Each condition is an equi-join, the second without
    # what the first has.
    step = F.floor(F.col("p_end") / (tolerance + 1))
    close = a.withColumn("_bin", F.explode(F.array(step - 1, step, step + 1))).join(b.withColumn("_gbin", F.floor(F.col("g_end") / (tolerance + 1))), (F.col("p_key") == F.col("g_key")) & (F.col("_bin") == F.col("_gbin"))).where(near).drop("_bin", "_gbin")
    return close.unionByName(overlapping(a, b, ("p_key", "g_key"), ("p_start", "p_end", "g_start", "g_end")).where(over & ~near))


def resample(values: DataFrame, old: DataFrame, new: DataFrame, key: str = PAIR) -> DataFrame:
    """Values on old frames carried to new frames over samples; the value
    of the last covered sample wins. ``old`` and ``new``: key, frame, s, e."""
    v = values.select(F.col(key).alias("k"), F.col("frame").alias("f"), "value")
    o = old.select(F.col(key).alias("k"), F.col("frame").alias("f"), F.col("s").alias("os"), F.col("e").alias("oe"))
    n = new.select(F.col(key).alias("nk"), "frame", "s", "e")
    hit = overlapping(v.join(o, ["k", "f"]), n, ("k", "nk"), ("os", "oe", "s", "e"), width=4096)
    return hit.groupBy(F.col("nk").alias(key), "frame").agg(F.max_by("value", F.struct(F.least("oe", "e"), "f")).alias("value"))


def majority_segments(segments: DataFrame, frames: DataFrame, key: str = PAIR, value: str = "value") -> DataFrame:
    """segments of which more than half the frames carry a value above 0,
    with the largest of them."""
    f = frames.select(F.col(key).alias("_k"), "pos", F.col(value).alias("v"))
    hit = covered(segments.select(key, "start", "end"), f, key, "_k")
    return hit.groupBy(key, "start", "end").agg(F.avg((F.col("v") > 0).cast("double")).alias("share"), F.max("v").alias("concept")).where("share > 0.5")
