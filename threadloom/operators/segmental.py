"""Segmental models: segment embeddings, segmentation by dynamic programming,
and a collapsed Gibbs sampler for finite Gaussian mixtures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.special import embed, log_gaussian, logsumexp

from .em import keep
from .hmm import add_up, nested, viterbi


def segment(marks: list[int], score: Callable[[int, int], float], shortest: int = 1, longest: int | None = None) -> tuple[list[int], float]:
    """Boundaries among ``marks`` (first 0, last the length) that maximise
    the summed score of the segments; a segment spans ``shortest`` to ``longest``
    marks. Ties go to the earlier start. Where no segmentation exists, the whole
    is one segment."""
    n = len(marks)
    best, back = [-np.inf] * n, [-1] * n
    best[0] = 0.0
    for j in range(1, n):
        for i in range(max(0, j - longest) if longest else 0, j - shortest + 1):
            if best[i] == -np.inf:
                continue
            s = best[i] + score(marks[i], marks[j])
            if s > best[j]:
                best[j], back[j] = s, i
    if back[-1] < 0:
        return [marks[0], marks[-1]], float(score(marks[0], marks[-1]))
    out, j = [marks[-1]], n - 1
    while j > 0:
        j = back[j]
        out.append(marks[j])
    return out[::-1], float(best[-1])


@dataclass
class Segmenter:
    """Segments one pair under ``models``: concept -> (mixtures, n x D) means of
    segment embeddings.

    ``kmeans`` minimises the duration-weighted squared distance to the nearest
    mean, ``gmm`` maximises the duration-weighted log density of the mixture of
    all the pair's concepts; ``hmm`` takes the landmark segments as given and
    runs Viterbi over the pair's concepts with probability ``move`` of going on.
    A duration is the number of frames; ``plus`` = 1 counts one more, as an older
    variant does.
    """

    models: dict[str, np.ndarray]
    n: int
    kind: str = "kmeans"
    technique: str = "resample"
    var: float = 0.02
    shortest: int = 1
    longest: int | None = 6
    move: float = 0.5
    plus: int = 0

    def scores(self, concept: str, e: np.ndarray) -> np.ndarray:
        """Score of an embedding under each mixture of a concept."""
        mean = self.models[concept]
        if self.kind == "kmeans":
            return -((mean - e) ** 2).sum(-1)
        return log_gaussian(e, mean, np.full(mean.shape, self.var)) - np.log(len(mean))

    def cuts(self, x: np.ndarray, marks: list[int], concepts: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """(segment, start, end, concept, embedding) in order."""
        concepts = [c for c in concepts if c in self.models]
        if not concepts or len(marks) < 2:
            return []
        cache: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def at(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
            if (i, j) not in cache:
                e = embed(x[i:j], self.n, self.technique)
                best = (lambda s: s.max()) if self.kind == "kmeans" else logsumexp
                cache[i, j] = e, np.array([best(self.scores(c, e)) for c in concepts])
            return cache[i, j]

        if self.kind == "hmm":
            spans = list(zip(marks, marks[1:], strict=False))
            e = np.array([at(i, j)[1] for i, j in spans])
            k = len(concepts)
            trans = np.full((k, k), self.move / max(k - 1, 1))
            np.fill_diagonal(trans, 1 - self.move if k > 1 else 1.0)
            path = viterbi(np.full(k, 1 / k), trans, np.exp(e - e.max(1, keepdims=True))[None])[0].tolist()
        else:
            whole = (lambda s: s.max()) if self.kind == "kmeans" else (lambda s: logsumexp(s) - np.log(len(s)))
            cut, _ = segment(marks, lambda i, j: (j - i + self.plus) * float(whole(at(i, j)[1])), self.shortest, self.longest)
            spans = list(zip(cut, cut[1:], strict=False))
            path = [int(np.argmax(at(i, j)[1])) for i, j in spans]
        return [(k, i, j, concepts[c], at(i, j)[0]) for k, ((i, j), c) in enumerate(zip(spans, path, strict=True))]

    def sums(self, x: np.ndarray, marks: list[int], concepts: list[str]) -> dict[str, np.ndarray]:
        """What a pair adds to counts and sums of each concept's mixtures: whole
        segments at the nearest mean, or (``gmm``) shares over the mixtures of
        all the pair's concepts; ``mark`` tells one segmentation from another."""
        found = self.cuts(x, marks, concepts)
        known = [c for c in concepts if c in self.models]
        out = {f"n/{c}": np.zeros(len(self.models[c])) for c in known} | {f"s/{c}": np.zeros(self.models[c].shape) for c in known}
        for _, _, _, concept, e in found:
            scores = {c: self.scores(c, e) for c in known}
            if self.kind == "gmm":
                total = logsumexp(np.concatenate([scores[c] for c in known]))
                shares = {c: np.exp(v - total) for c, v in scores.items()}
            else:
                shares = {concept: np.eye(len(scores[concept]))[scores[concept].argmax()]}
            for c, w in shares.items():
                out[f"n/{c}"] += w
                out[f"s/{c}"] += w[:, None] * e
        out["mark"] = np.array([float(crc32(repr([f[:4] for f in found]).encode()))])
        return out


def _rows(b: pa.RecordBatch):
    for p, x, marks, concepts in zip(*(b.column(c).to_pylist() for c in ("pair_index", "x", "marks", "concepts")), strict=True):
        yield p, np.array(x, float), marks, concepts


def segment_all(pairs: DataFrame, models: dict[str, np.ndarray], n: int, kind: str = "kmeans", technique: str = "resample", **kw) -> DataFrame:
    """M07, M08, M09 decoding (``Segmenter``). ``pairs``: ``pair_index, x``
    (frames), ``marks`` (landmarks), ``concepts``. Returns ``pair_index, seg,
    start, end, concept``. A task holds one pair's frames."""
    sent = pairs.sparkSession.sparkContext.broadcast(Segmenter(models, n, kind, technique, **kw))

    def run(it):
        for b in it:
            out = [(p, *f[:4]) for p, x, marks, concepts in _rows(b) for f in sent.value.cuts(x, marks, concepts)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["pair_index", "seg", "start", "end", "concept"])

    return pairs.mapInArrow(run, "pair_index long, seg long, start long, end long, concept string")


def train_segments(pairs: DataFrame, models: dict[str, np.ndarray], n: int, rounds: int, kind: str = "kmeans", technique: str = "resample", **kw) -> dict[str, np.ndarray]:
    """M07, M08, M09 training: segment all pairs under the present means, then
    take each mean over the embeddings of its segments (shares of them for
    ``gmm``; ``hmm`` trains on its best paths). A mean without segments stays.
    Ends after ``rounds`` or when no segmentation changes. Sums as large as the
    means are added up across partitions; nothing else reaches the driver."""
    last = None
    for _ in range(rounds):
        sent = pairs.sparkSession.sparkContext.broadcast(Segmenter(models, n, kind, technique, **kw))
        got = add_up(pairs, lambda b, sent=sent: (sent.value.sums(x, marks, concepts) for _, x, marks, concepts in _rows(b)))
        if not got or got["mark"][0] == last:
            break
        last = got["mark"][0]
        shares = {c: got.get(f"n/{c}", np.zeros(len(m))) for c, m in models.items()}
        models = {c: np.where(shares[c][:, None] > 0, got.get(f"s/{c}", np.zeros(m.size)).reshape(m.shape) / np.maximum(shares[c], 1e-300)[:, None], m) for c, m in models.items()}
    return models


#: Fixed value: embedded segments that a task holds at once.
SEGMENTS = 1024


def embed_segments(pairs: DataFrame, n: int, technique: str = "resample", longest: int = 6) -> DataFrame:
    """Embeddings of all segments between landmarks up to ``longest`` apart:
    ``pair_index, start, end, vec``."""

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))

    def segments(b):
        (nx, fx, xs), (nm, fm, every) = nested(b.column("x")), nested(b.column("marks"))
        for r, p in enumerate(b.column("pair_index").to_pylist()):
            x, marks = xs[fx[r] : fx[r] + nx[r]], every[fm[r] : fm[r] + nm[r]].tolist()
            for i, s in enumerate(marks):
                for e in marks[i + 1 : i + 1 + longest]:
                    yield p, s, e, embed(x[s:e], n, technique)

    def run(it):
        for b in it:
            rows = segments(b)
            while out := list(islice(rows, SEGMENTS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["pair_index", "start", "end", "vec"])

    return pairs.mapInArrow(run, "pair_index long, start long, end long, vec array<double>")


class GibbsMixture:
    """Finite Bayesian Gaussian mixture with fixed diagonal variance, by
    collapsed Gibbs sampling with annealing. Sweeps are sequential by nature:
    this is the kernel of one partition. ``start``: the rows' components, and
    the counts and sums of all rows, also of other partitions."""

    def __init__(self, x: np.ndarray, k: int, var: float, prior_var: float = 1.0, alpha: float = 1.0, seed: int | list[int] = 0, start: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.x, self.k, self.var, self.prior_var, self.alpha = np.asarray(x, float), k, var, prior_var, alpha
        self.rng = np.random.default_rng(seed)
        if start is not None:
            self.z, self.n, self.s = (a.copy() for a in start)
            return
        self.z = self.rng.integers(0, k, len(x))
        self.n = np.bincount(self.z, minlength=k).astype(float)
        self.s = np.stack([self.x[self.z == c].sum(0) for c in range(k)])

    def log_predictive(self, x: np.ndarray) -> np.ndarray:
        """log p(x | the rest of each component): the posterior predictive."""
        post = 1 / (1 / self.prior_var + self.n / self.var)
        mean = (post / self.var)[:, None] * self.s
        return log_gaussian(x, mean, (post + self.var)[:, None] * np.ones_like(self.s))

    def log_prior(self) -> np.ndarray:
        return np.log(self.n + self.alpha / self.k)

    def sweep(self, temperature: float = 1.0) -> None:
        for i in range(len(self.x)):
            self._move(i, -1.0)
            p = (self.log_prior() + self.log_predictive(self.x[i])) / temperature
            p = np.exp(p - logsumexp(p))
            self.z[i] = int(np.searchsorted(np.cumsum(p), self.rng.random() * p.sum()).clip(0, self.k - 1))
            self._move(i, 1.0)

    def settle(self) -> None:
        """One sweep of best assignments (MAP)."""
        for i in range(len(self.x)):
            self._move(i, -1.0)
            self.z[i] = int(np.argmax(self.log_prior() + self.log_predictive(self.x[i])))
            self._move(i, 1.0)

    def _move(self, i: int, sign: float) -> None:
        self.n[self.z[i]] += sign
        self.s[self.z[i]] += sign * self.x[i]

    def fit(self, sweeps: int, hottest: float = 1.0, schedule: str = "linear", shrink: int | None = None) -> list[float]:
        """Annealed sweeps (``linear`` or ``step``), then one MAP sweep; with
        ``shrink`` only that many of the largest components remain."""
        history = []
        for n in range(sweeps):
            t = hottest + (1 - hottest) * n / max(sweeps - 1, 1) if schedule == "linear" else (hottest if n < sweeps // 2 else 1.0)
            self.sweep(t)
            history.append(self.log_joint())
        if shrink is not None and shrink < self.k:
            keep = np.sort(np.argsort(-self.n, kind="stable")[:shrink])
            self.k, self.n, self.s = shrink, self.n[keep], self.s[keep]
            place = {int(c): j for j, c in enumerate(keep)}
            gone = [i for i in range(len(self.x)) if int(self.z[i]) not in place]
            self.z = np.array([place.get(int(c), 0) for c in self.z])
            for i in gone:
                self.z[i] = int(np.argmax(self.log_prior() + self.log_predictive(self.x[i])))
                self._move(i, 1.0)
        self.settle()
        return history

    def log_joint(self) -> float:
        """Sum of each point's log prior share and predictive density given all."""
        share = np.log((self.n + self.alpha / self.k) / (len(self.x) + self.alpha))
        return float(sum(share[z] + self.log_predictive(x)[z] for x, z in zip(self.x, self.z, strict=True)))


def gibbs_mixture(rows: DataFrame, k: int, var: float, sweeps: int, hottest: float = 1.0, prior_var: float = 1.0, alpha: float = 1.0, seed: int = 0, per_part: int = 4096) -> DataFrame:
    """M26 over all of ``rows`` (``id, x``): ``id, component``.

    Rows are dealt by hash to partitions of about ``per_part``. In each round
    every partition sweeps its rows, starting from the counts and sums of all
    rows; the driver then receives the new ones (k rows). Sums are taken in units
    of 2^-30, so their order does not matter and runs repeat. With one partition
    this is the sequential sampler. ``sweeps`` rounds cool linearly from
    ``hottest`` to 1, and a round of best assignments follows.
    """
    parts = max(1, -(-rows.count() // per_part))
    state = rows.select("id", "x", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)).cast("int").alias("z"))
    state = keep(state.repartition(parts, F.xxhash64("id")).sortWithinPartitions("id", "x"))
    first = state.select(F.size("x")).first()
    if first is None:
        return rows.select("id", F.lit(0).alias("component"))
    dim, unit = first[0], float(1 << 30)
    kind = state.schema["id"].dataType.simpleString()
    for turn in range(sweeps + 1):
        n, s = np.zeros(k), np.zeros((k, dim))
        for r in state.groupBy("z").agg(F.count(F.lit(1)), *[F.sum(F.round(F.get("x", F.lit(i)) * unit).cast("long")) for i in range(dim)]).collect():  # k rows
            n[r[0]], s[r[0]] = r[1], np.array(r[2:], float) / unit
        heat = hottest + (1 - hottest) * turn / max(sweeps - 1, 1) if turn < sweeps else None

        def run(it, turn=turn, n=n, s=s, heat=heat):
            table = pa.Table.from_batches(batches) if (batches := list(it)) else None
            if table is None or not len(table):
                return
            x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            g = GibbsMixture(x, k, var, prior_var, alpha, [seed, turn, TaskContext.get().partitionId()], (table["z"].to_numpy(), n, s))
            if heat is None:
                g.settle()
            else:
                g.sweep(heat)
            yield from pa.table({"id": table["id"], "x": table["x"], "z": pa.array(g.z, pa.int32())}).to_batches()

        state = keep(state.mapInArrow(run, f"id {kind}, x array<double>, z int"))
    return state.select("id", F.col("z").alias("component"))
