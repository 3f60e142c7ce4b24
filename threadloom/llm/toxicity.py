"""Toxicity by multiple-instance learning: noisy-or over sentence scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: A word's features are the word and its prefixes of these lengths.
PREFIXES = (3, 4, 5, 6)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def sentences(text: str) -> Iterator[re.Match]:
    """What stands between the marks ``.!?`` and line ends, blank pieces left out."""
    return (m for m in SENTENCE.finditer(text) if not m.group().isspace())


@dataclass
class Model:
    """``weights`` of features; ``bias`` of a sentence that has any; ``leak``,
    the log odds that a text is toxic whatever its sentences say."""

    weights: dict[str, float]
    bias: float
    leak: float = -20.0

    def quiet(self) -> float:
        """The score of a text without evidence, of any length."""
        return float(1 / (1 + np.exp(-self.leak)))

    def word_scores(self) -> "WordScores":
        return WordScores(self.weights)


class WordScores(dict):
    """Score of each word that shares its first letters with a feature; any
    other word scores 0 and isn't stored, nor is a word of more than ``longest``
    letters. Forgets all when it gets large, so it is bounded in bytes."""

    def __init__(self, weights: dict[str, float], most: int = 500_000, longest: int = 64):
        self.weights, self.most, self.longest = weights, most, longest
        self.heads = {f.rstrip("*")[: PREFIXES[0]] for f in weights}

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self.clear()
        w = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(word) <= self.longest:
            self[word] = w
        return w

    def total(self, words: Iterable[str]) -> float:
        heads, n = self.heads, PREFIXES[0]
        return sum(self[w] for w in words if w[:n] in heads)

    def any(self, words: Iterable[str]) -> bool:
        heads, n = self.heads, PREFIXES[0]
        return any(self[w] for w in words if w[:n] in heads)


def sentence_probs(model: Model, scores: WordScores, text: str) -> list[tuple[int, int, float]]:
    """(start, end, probability) of each sentence that has a feature; code points."""
    out = []
    for m in sentences(text):
        words = set(WORD.findall(m.group().lower()))
        if scores.any(words):
            out.append((m.start(), m.end(), float(1 / (1 + np.exp(-model.bias - scores.total(words))))))
    return out


def judged(model: Model, scores: WordScores, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """The text's score and the sentences behind it: the noisy-or of the leak,
    once, and of the sentences that have a feature, 1 - (1 - leak) * product of
    (1 - p). Sentences without features add nothing, so length alone adds nothing."""
    if not scores.any(set(WORD.findall(text.lower()))):
        return model.quiet(), []
    found = sentence_probs(model, scores, text)
    off = np.log1p(-model.quiet()) + sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in found)
    return float(1 - np.exp(off)), found


def score_text(model: Model, scores: WordScores, text: str) -> float:
    return judged(model, scores, text)[0]


def _counted(texts: Iterable[tuple[str, int]], flush: int = 200_000) -> Iterator[dict[str, list[int]]]:
    """How many documents with label 0 and 1 have each feature, in portions of
    about ``flush`` features."""
    seen: dict[str, list[int]] = {}
    for text, y in texts:
        for f in {f for w in set(WORD.findall(text.lower())) for f in features(w)}:
            seen.setdefault(f, [0, 0])[y] += 1
        if len(seen) > flush:
            yield seen
            seen = {}
    yield seen


def choose_features(sample: DataFrame, least: int = 3, z: float = 4.0, most: int = 4000) -> list[str]:
    """Features of at least ``least`` documents of ``sample`` (``text, y``) whose
    share among the positive documents is ``z`` standard errors above the rest,
    strongest first, at most ``most``. Counted in the executors."""

    def run(it):
        for seen in _counted((t or "", y) for b in it for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True)):
            counts = list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], ["f", "c0", "c1"])

    n = sample.agg(F.sum("y").alias("n1"), F.count("y").alias("n")).first()
    n1, n0 = float(max(1, n["n1"] or 0)), float(max(1, n["n"] - (n["n1"] or 0)))
    c0, c1 = F.col("c0"), F.col("c1")
    p = (c1 + c0 + 1) / (n1 + n0 + 2)
    gain = (c1 / n1 - c0 / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    counts = sample.select("text", "y").mapInArrow(run, "f string, c0 bigint, c1 bigint").groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    top = counts.where(c0 + c1 >= least).select("f", gain.alias("gain")).where(F.col("gain") >= z).orderBy(F.desc("gain"), "f").limit(most)
    return [r["f"] for r in top.collect()]


@dataclass
class Bags:
    """Documents as bags of sentences: ``doc, times`` of each different set of
    features that sentences of a document have, the features of set i as
    ``cols[ends[i]:ends[i + 1]]``. Sentences without features aren't listed."""

    labels: np.ndarray
    doc: np.ndarray
    times: np.ndarray
    cols: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, list[int], list[int], list[int]]]) -> "Bags":
        """From (label, times, sizes, cols) of each document."""
        flat = lambda k, kind: np.concatenate([np.asarray(r[k], kind) for r in rows]) if rows else np.zeros(0, kind)
        doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        return cls(np.array([r[0] for r in rows], float), doc, flat(1, float), flat(3, np.int64), np.concatenate([[0], np.cumsum(flat(2, np.int64))]))


def bag(index: dict[str, int], heads: set[str], text: str) -> tuple[list[int], list[int], list[int]]:
    """(times, sizes, cols) of one text."""
    seen: Counter = Counter()
    for m in sentences(text):
        words = {w for w in WORD.findall(m.group().lower()) if w[: PREFIXES[0]] in heads}
        if hits := {index[f] for w in words for f in features(w) if f in index}:
            seen[tuple(sorted(hits))] += 1
    sets = sorted(seen)
    return [seen[s] for s in sets], [len(s) for s in sets], [c for s in sets for c in s]


def likelihood(bags: Bags, theta: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Mean log likelihood of the document labels less the decay term, and its
    gradient, by the weights, the sentence bias and the leak (``theta`` in this
    order). The chance that a document is positive is the noisy-or of the leak
    and its sentences: 1 - (1 - sigmoid(leak)) * product of (1 - sigmoid(bias +
    sum of weights))."""
    sums = np.add.reduceat(np.append(theta[bags.cols], 0.0), bags.ends[:-1]) if len(bags.times) else np.zeros(0)
    p, q = 1 / (1 + np.exp(-(theta[-2] + sums))), 1 / (1 + np.exp(-theta[-1]))
    n = len(bags.labels)
    off = np.bincount(bags.doc, bags.times * np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n) + np.log1p(-q)
    on = np.clip(1 - np.exp(off), 1e-9, 1 - 1e-9)
    pull = (bags.labels - on) / on
    each = p * bags.times * pull[bags.doc]
    g = np.concatenate([np.bincount(bags.cols, np.repeat(each, np.diff(bags.ends)), minlength=len(theta) - 2), [each.sum(), (q * pull).sum()]]) / n
    w = np.append(theta[:-2], [0, 0])
    return float((bags.labels * np.log(on) + (1 - bags.labels) * np.log1p(-on)).mean() - decay / 2 * (w @ w)), g - decay * w


def train_bags(names: list[str], bags: Bags, rounds: int = 300, rate: float = 0.1, decay: float = 2e-5) -> Model:
    """Gradient ascent (Adam) on ``likelihood``."""
    labels = bags.labels
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model({}, -5.0, float(np.log(share / (1 - share))))
    theta = np.zeros(len(names) + 2)
    theta[-2:] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        g = likelihood(bags, theta, decay)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(theta[i]) for i, f in enumerate(names)}, float(theta[-2]), float(theta[-1]))


def train(sample: DataFrame, least: int = 3, z: float = 4.0, most: int = 4000) -> Model:
    """A model from ``sample`` (``id, text, y``), which has a bounded number of
    rows. Executors count features and cut texts into bags; the driver gets the
    chosen features of the sample's sentences, never its texts."""
    names = choose_features(sample, least, z, most)
    sent = sample.sparkSession.sparkContext.broadcast(names)  # at most `most` names

    def run(it):
        index = {f: i for i, f in enumerate(sent.value)}
        heads = {f.rstrip("*")[: PREFIXES[0]] for f in index}
        for b in it:
            rows = [bag(index, heads, t or "") for t in b.column("text").to_pylist()]
            lists = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), *lists], ["id", "y", "times", "sizes", "cols"])

    kind = sample.schema["id"].dataType.simpleString()
    got = sample.select("id", "text", "y").mapInArrow(run, f"id {kind}, y int, times array<int>, sizes array<int>, cols array<int>").toArrow()
    cols = [got.column(k).to_pylist() for k in got.column_names]
    return train_bags(names, Bags.of([r[1:] for r in sorted(zip(*cols, strict=True))]))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    positive: int = 3000,
    negative: int = 5000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    spare: int = 3,
    most: int = 4000,
) -> Model:
    """A model from labelled rows that aren't held out.

    The bounds of the training sample: ``spare`` times ``positive`` and
    ``negative`` labelled ids, the smallest by a hash of the id, and of their
    texts at most ``positive`` and ``negative`` different ones by a hash of the
    text, so that copies of one text count once (toxic if one of them is
    marked so). An id with several labels is toxic if one says so, one with
    several texts teaches with the smallest; null ids and labels are ignored.
    The model has at most ``most`` features. ``docs`` is scanned once, at full
    width, and the sample is kept in the shared folder.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y"))
    # Counts per slice of the hash range say where to stop, so that tasks hand on
    # no more rows than the sample has.
    parts = 1 << 16
    marks = marks.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(parts)))
    seen = {0: [0] * parts, 1: [0] * parts}
    for r in marks.groupBy("_y", "_part").count().collect():  # at most 2 x 65536 rows
        seen[r["_y"]][r["_part"]] = r["count"]
    picked = []
    for y, rows in ((1, positive * spare), (0, negative * spare)):
        total, stop = 0, 0
        while stop < parts and total < rows:
            total += seen[y][stop]
            stop += 1
        picked.append(marks.where((F.col("_y") == y) & (F.col("_part") < stop)).orderBy("_part", "_id").limit(rows))
    some = picked[0].unionByName(picked[1]).select("_id", "_y")
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with scratch(docs.sparkSession):
        found = cut(rows.join(F.broadcast(some), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min("text").alias("text"), F.max("_y").alias("y")))
        texts = cut(found.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.min("_id").alias("id"), F.max("y").alias("y")))
        first = lambda y, rows: texts.where(F.col("y") == y).select("id", "h").orderBy("h", "id").limit(rows).select("id")
        sample = cut(texts.join(F.broadcast(first(1, positive).unionByName(first(0, negative))), "id", "left_semi").select("id", "text", "y").repartition(64))
        return train(sample, most=most)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, cutoff: float = 0.5) -> DataFrame:
    """``doc_id, score`` (0 to 1) of every whole text, and with ``spans`` the
    sentences whose own probability is ``cutoff`` or more.

    Sees texts only. Texts without evidence (nulls and empty ones, clean ones of
    any length) score the leak. Repeated rows score alike; other columns are
    ignored. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 4000 weights
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    where = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(it):
        m = sent.value
        words = m.word_scores()
        for b in it:
            col = b.column("text")
            texts = [col[i].as_py() or "" for i in range(len(col))]
            found = [judged(m, words, t) for t in texts]
            out = [b.column("doc_id"), pa.array([f[0] for f in found], pa.float64())]
            if spans:
                out.append(pa.array([[{"start": s, "end": e, "p": p} for s, e, p in f[1] if p >= cutoff] for f in found], where))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "spans"][: len(out)])

    return rows.mapInArrow(run, f"doc_id {kind}, score double" + ", spans array<struct<start:int,end:int,p:double>>" * spans)


def drop_toxic(docs: DataFrame, model: Model, cutoff: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``cutoff`` or more: one pass over
    whole rows, whatever their columns; no join, no shuffle. A null or empty text
    scores as any text without evidence; repeated rows go or stay together."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = sent.value
        words = m.word_scores()
        for b in it:
            col = b.column(at)
            yield b.filter(pa.array([score_text(m, words, col[i].as_py() or "") < cutoff for i in range(len(col))], pa.bool_()))

    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots can't be mapped
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
