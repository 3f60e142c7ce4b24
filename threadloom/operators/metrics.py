"""Evaluation: alignment, clustering, segmentation, retrieval, error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.numeric import edit_counts

from .segments import best_iou, covered, matched_boundaries

PAIR = "pair_index"


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def confusion(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Counts of (pred, gold) and the share of each gold column."""
    c = df.groupBy(pred, gold).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(gold)))


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Mean over labels 0..max of the largest share that one cluster has of
    the label's rows; labels that never occur count as 0."""
    c = confusion(df, cluster, label)
    best = c.groupBy(label).agg(F.max("share").alias("best"))
    return best.agg((F.sum("best") / (F.max(label) + 1)).alias("purity"))


def accuracy(df: DataFrame, pred: str = "pred", gold: str = "gold", max_len: int = 2000, pos: str = "pos") -> DataFrame:
    """A10: share of equal positions among the first ``max_len`` of each pair."""
    return df.where(F.col(pos) < max_len).agg(F.avg((F.col(pred) == F.col(gold)).cast("double")).alias("accuracy"))


def local_scores(df: DataFrame, pred: str = "pred", gold: str = "gold", key: str = PAIR) -> DataFrame:
    """A11 per pair: recall and precision as means over classes 0..max index of
    the pair; classes without rows count as 0."""
    v = df.groupBy(key).agg((F.greatest(F.max(pred), F.max(gold)) + 1).alias("v"))
    g = df.groupBy(key, F.col(gold).alias("c")).agg(F.avg((F.col(pred) == F.col(gold)).cast("double")).alias("x"))
    p = df.groupBy(key, F.col(pred).alias("c")).agg(F.avg((F.col(pred) == F.col(gold)).cast("double")).alias("x"))
    r = g.groupBy(key).agg(F.sum("x").alias("r"))
    q = p.groupBy(key).agg(F.sum("x").alias("p"))
    return v.join(r, key).join(q, key).select(key, (F.col("r") / F.col("v")).alias("recall"), (F.col("p") / F.col("v")).alias("precision"))


def local_prf(df: DataFrame, **kw) -> DataFrame:
    """Means over pairs, and their harmonic mean."""
    m = local_scores(df, **kw).agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"))
    return m.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def concept_prf(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Corpus-level macro recall (diagonal over gold totals) and precision
    (diagonal over predicted totals) over the concepts of either side."""
    r = df.groupBy(F.col(gold).alias("c")).agg(F.avg((F.col(pred) == F.col(gold)).cast("double")).alias("r"))
    p = df.groupBy(F.col(pred).alias("c")).agg(F.avg((F.col(pred) == F.col(gold)).cast("double")).alias("p"))
    both = r.join(p, "c", "full").select(F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("p", F.lit(0.0)).alias("p"))
    m = both.agg(F.avg("r").alias("recall"), F.avg("p").alias("precision"))
    return m.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def word_iou(pred: DataFrame, gold: DataFrame, key: str = PAIR) -> DataFrame:
    """Mean best IoU of the predicted spans."""
    return best_iou(pred, gold, key).agg(F.avg("iou").alias("iou"))


def segmentation_prf(pred: DataFrame, gold: DataFrame, tolerance: int = 1, key: str = PAIR) -> DataFrame:
    """Matches between spans other than each side's last, over the number of
    all spans, per pair, averaged."""
    m = matched_boundaries(pred, gold, tolerance, key=key).groupBy(F.col("p_key").alias(key)).agg(F.count(F.lit(1)).alias("m"))
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = n(pred, "np").join(n(gold, "ng"), key).join(m, key, "left").na.fill({"m": 0})
    out = both.agg(F.avg(F.col("m") / F.col("ng")).alias("recall"), F.avg(F.col("m") / F.col("np")).alias("precision"))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Counts and shares."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("_all")))).select(label, "n", (F.col("n") / F.col("_all")).alias("share"))


def length_histogram(spans: DataFrame) -> DataFrame:
    """Span lengths with counts."""
    return spans.groupBy((F.col("end") - F.col("start")).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def mean_length(spans: DataFrame, compat: bool = False) -> DataFrame:
    """Mean span length; ``compat`` gives the histogram-index mean, one more."""
    return spans.agg((F.avg(F.col("end") - F.col("start")) + (1 if compat else 0)).alias("mean_length"))


def recall_at(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10), rank: str = "rank") -> DataFrame:
    """Share of queries whose true item ranks within k (1 is best)."""
    return ranks.agg(*[F.avg((F.col(rank) <= k).cast("double")).alias(f"recall_{k}") for k in ks])


def span_mode(spans: DataFrame, frames: DataFrame, value: str, key: str = PAIR) -> DataFrame:
    """The most frequent value inside each span, ties to the smaller."""
    f = frames.select(F.col(key).alias("_k"), "pos", F.col(value).alias("v"))
    hit = covered(spans.select(key, "start", "end"), f, key, "_k")
    c = hit.groupBy(key, "start", "end", "v").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(key, "start", "end").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))


def roc_points(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Per group and threshold the true and false positive rates of
    ``score >= threshold``. Counts are summed per threshold before the running
    sum, so a group holds a row per distinct score."""
    c = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    rate = lambda x: F.coalesce(F.try_divide(F.sum(x).over(w), F.sum(x).over(whole)), F.lit(0.0))
    return c.select(*by, "threshold", rate("p").alias("tpr"), rate("n").alias("fpr"))


def class_accuracy(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Accuracy and support of each class."""
    return df.groupBy(gold).agg(F.avg((F.col(pred) == F.col(gold)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def class_f1(df: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """One-vs-rest F1 and support of each class."""
    g = df.groupBy(F.col(gold).alias("c")).agg(F.count(F.lit(1)).alias("support"), F.sum((F.col(pred) == F.col(gold)).cast("long")).alias("tp"))
    p = df.groupBy(F.col(pred).alias("c")).agg(F.count(F.lit(1)).alias("found"))
    j = g.join(p, "c", "left").na.fill({"found": 0})
    return j.select("c", "support", F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("support") + F.col("found"))).otherwise(F.lit(0.0)).alias("f1"))


def token_clusters(df: DataFrame, concept: str, token: str) -> DataFrame:
    """The sorted distinct tokens of each concept."""
    return df.groupBy(concept).agg(F.array_sort(F.collect_set(token)).alias("tokens"))


def word_error_totals(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Sums of distance, insertions, deletions, substitutions, matches."""
    e = df.select(edit_counts(F.col(ref), F.col(hyp)).alias("e"), F.size(ref).alias("n"))
    return e.agg(*[F.sum(f"e.{c}").alias(c) for c in ("dist", "ins", "del", "sub", "corr")], F.sum("n").alias("ref_tokens"))


def masked_cross_entropy(df: DataFrame, prob: str, mask: str) -> DataFrame:
    """Mean of -log p over the positions whose mask is 1; p below 1e-30 counts as that."""
    m = F.col(mask).cast("double")
    return df.agg((F.sum(-F.log(F.greatest(F.col(prob), F.lit(1e-30))) * m) / F.sum(m)).alias("loss"))


def margin_rank_loss(df: DataFrame, true: str, wrong: str, margin: float = 1.0) -> DataFrame:
    """Mean of max(0, margin + wrong - true)."""
    return df.agg(F.avg(F.greatest(F.col(wrong) - F.col(true) + margin, F.lit(0.0))).alias("loss"))


def coverage(spans: DataFrame, lengths: DataFrame, key: str = PAIR) -> DataFrame:
    """Share of all positions that lie inside a span; spans of a pair may
    overlap, a position counts once."""
    s = spans.select(key, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct()
    return s.agg(F.count(F.lit(1)).alias("hit")).crossJoin(lengths.agg(F.sum("n").alias("n"))).select((F.col("hit") / F.col("n")).alias("coverage"))


def normalised_edit_distance(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Mean over pairs of edit distance by the longer length."""
    d = edit_counts(F.col(left), F.col(right))["dist"] / F.greatest(F.size(left), F.size(right), F.lit(1))
    return pairs.agg(F.avg(d).alias("ned"))


def transcribed(spans: DataFrame, units: DataFrame, key: str = PAIR, unit: str = "token") -> DataFrame:
    """``spans`` (``key, start, end``, other columns) with ``text``: the
    units whose positions they hold, in order. An interval join by bins, then a
    group a span, which is as long as the span."""
    u = units.select(F.col(key).alias("_uk"), "pos", F.col(unit).alias("_u"))
    hit = covered(spans, u, key, "_uk")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_u"))), lambda x: x["_u"])
    return hit.groupBy(*spans.columns).agg(F.array_join(listed, " ").alias("text"))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def _prf(row: DataFrame, hit: str, found: str, gold: str) -> DataFrame:
    """``precision, recall, f1`` of a row of counts; 0 where nothing is counted."""
    r = row.select(_ratio(hit, found).alias("precision"), _ratio(hit, gold).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return r.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def grouping_prf(found: DataFrame, cls: str = "cls", text: str = "text") -> DataFrame:
    """A29 grouping: of all pairs of segments in one discovered class the share
    with equal transcriptions (precision); of all pairs with equal transcriptions
    the share in one class (recall). Pairs are counted, never listed: n(n-1)/2
    of each histogram cell, so a class with a third of all segments is a row per
    different transcription."""
    cells = found.groupBy(cls, text).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda df: F.coalesce(F.sum((F.col("n").cast("decimal(19,0)") * (F.col("n") - 1) / 2).cast("decimal(38,0)")), F.lit(0)).cast("double")
    by = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs(cells).alias(name))
    return _prf(cells.agg(pairs(cells).alias("hit")).crossJoin(by(cls, "found")).crossJoin(by(text, "gold")), "hit", "found", "gold")


def _set_prf(found: DataFrame, gold: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    found, gold = found.distinct(), gold.distinct()
    return _prf(n(found.join(gold, found.columns, "left_semi"), "hit").crossJoin(n(found, "found")).crossJoin(n(gold, "gold")), "hit", "found", "gold")


def edge_prf(found: DataFrame, gold: DataFrame, key: str = PAIR) -> DataFrame:
    """A29 boundary: of the different edges of discovered segments the share that
    are edges of gold segments, and the reverse."""
    edges = lambda df: df.select(key, F.explode(F.array("start", "end")).alias("edge"))
    return _set_prf(edges(found), edges(gold))


def type_prf(found: DataFrame, gold: DataFrame, text: str = "text") -> DataFrame:
    """A29 type: of the different transcriptions of discovered segments the share
    that are gold words, and the reverse."""
    return _set_prf(found.select(text), gold.select(text))
