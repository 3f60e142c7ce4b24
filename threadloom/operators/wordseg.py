"""Blocked Gibbs sampling over segmentations and components together.

A pair's lattice holds every segment between landmarks up to ``longest`` apart.
A sweep takes the pair's segments out of the component counts, scores each
segment by the mixture's predictive density (weighted by its duration), filters
forward over the landmarks, samples cuts backward, and draws a component for
every new segment. Partitions sweep side by side from the same counts and
exchange sums after every round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.special import embed, log_gaussian, logsumexp
from threadloom.sources.shared import keep

#: Sums travel in units of 2^-30, so their order doesn't matter.
_UNIT = float(1 << 30)


@dataclass
class Components:
    """Counts and sums of a finite Bayesian mixture of Gaussians with fixed
    diagonal variance."""

    n: np.ndarray
    s: np.ndarray
    var: float
    prior_var: float = 1.0
    alpha: float = 1.0

    def move(self, k: int, e: np.ndarray, sign: float) -> None:
        self.n[k] += sign
        self.s[k] += sign * e

    def log_joint(self, e: np.ndarray) -> np.ndarray:
        """log prior share (up to a constant) + log predictive density of each
        embedding (rows of ``e``) under each component."""
        post = 1 / (1 / self.prior_var + self.n / self.var)
        mean = (post / self.var)[:, None] * self.s
        density = log_gaussian(np.atleast_2d(e)[:, None, :], mean[None], (post + self.var)[None, :, None] * np.ones_like(mean)[None])
        return np.log(self.n + self.alpha / len(self.n)) + density

    def log_marginal(self, e: np.ndarray) -> np.ndarray:
        joint = self.log_joint(e)
        top = joint.max(1)
        return top + np.log(np.exp(joint - top[:, None]).sum(1)) - np.log(self.n.sum() + self.alpha)


@dataclass
class Lattice:
    """Segments between ``shortest`` and ``longest`` marks of one pair, with
    their embeddings, and what is computed over them."""

    x: np.ndarray
    marks: list[int]
    n: int
    technique: str = "resample"
    shortest: int = 1
    longest: int = 6
    spans: list[tuple[int, int]] = field(init=False)
    vectors: np.ndarray = field(init=False)

    def __post_init__(self):
        last = len(self.marks) - 1
        self.spans = [(i, j) for j in range(1, last + 1) for i in range(max(0, j - self.longest), j - self.shortest + 1)]
        if last and not self._reaches(last):
            self.spans.append((0, last))  # no way through: the whole is one segment
        self.at = {s: k for k, s in enumerate(self.spans)}
        self.vectors = np.stack([embed(self.x[self.marks[i] : self.marks[j]], self.n, self.technique) for i, j in self.spans]) if self.spans else np.zeros((0, 0))

    def _reaches(self, last: int) -> bool:
        seen = {0}
        for i, j in self.spans:
            if i in seen:
                seen.add(j)
        return last in seen

    def scores(self, model: Components, power: float = 1.0) -> np.ndarray:
        """log marginal of each segment times its duration to the ``power``."""
        time = np.array([self.marks[j] - self.marks[i] for i, j in self.spans], float)
        return model.log_marginal(self.vectors) * time**power

    def forward(self, scores: np.ndarray) -> np.ndarray:
        """log of the summed weights of all ways from the first mark to each."""
        alpha = np.full(len(self.marks), -np.inf)
        alpha[0] = 0.0
        into: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(self.spans):
            into.setdefault(j, []).append(k)
        for j, ks in sorted(into.items()):
            terms = np.array([alpha[self.spans[k][0]] + scores[k] for k in ks])
            if np.isfinite(terms).any():
                alpha[j] = logsumexp(terms)
        return alpha

    def sample(self, scores: np.ndarray, draw) -> list[tuple[int, int]]:
        """Segments drawn backward from the filter; ``draw()`` is uniform in [0, 1)."""
        alpha = self.forward(scores)
        out, j = [], len(self.marks) - 1
        while j:
            ways = [k for k, s in enumerate(self.spans) if s[1] == j and np.isfinite(alpha[s[0]])]
            terms = np.array([alpha[self.spans[k][0]] + scores[k] for k in ways])
            share = np.cumsum(np.exp(terms - terms.max()))
            k = ways[int(np.searchsorted(share, draw() * share[-1], side="right").clip(0, len(ways) - 1))]
            out.append(self.spans[k])
            j = self.spans[k][0]
        return out[::-1]

    def best(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """Segments of the best way; ties go to the earlier start."""
        top, back = np.full(len(self.marks), -np.inf), {}
        top[0] = 0.0
        for k, (i, j) in sorted(enumerate(self.spans), key=lambda t: (t[1][1], t[1][0])):
            if top[i] + scores[k] > top[j]:
                top[j], back[j] = top[i] + scores[k], i
        out, j = [], len(self.marks) - 1
        while j:
            out.append((back[j], j))
            j = back[j]
        return out[::-1]

    def cut_posteriors(self, scores: np.ndarray) -> np.ndarray:
        """Probability of a cut at each mark (1 at both ends)."""
        alpha, beta = self.forward(scores), np.full(len(self.marks), -np.inf)
        beta[-1] = 0.0
        out: dict[int, list[int]] = {}
        for k, (i, _) in enumerate(self.spans):
            out.setdefault(i, []).append(k)
        for i, ks in sorted(out.items(), reverse=True):
            terms = np.array([beta[self.spans[k][1]] + scores[k] for k in ks])
            if np.isfinite(terms).any():
                beta[i] = logsumexp(terms)
        with np.errstate(invalid="ignore"):
            p = np.exp(alpha + beta - alpha[-1])
        return np.nan_to_num(p)


@dataclass
class Settings:
    k: int
    n: int
    var: float
    prior_var: float = 1.0
    alpha: float = 1.0
    technique: str = "resample"
    shortest: int = 1
    longest: int = 6
    power: float = 1.0
    boundary: float = 0.1
    seed: int = 0

    def lattice(self, x: np.ndarray, marks: list[int]) -> Lattice:
        return Lattice(x, marks, self.n, self.technique, self.shortest, self.longest)

    def first(self, lattice: Lattice, rng) -> tuple[list[tuple[int, int]], list[int]]:
        """A random way through the lattice (a cut at an allowed mark with
        probability ``boundary``) and random components."""
        spans, i, last = [], 0, len(lattice.marks) - 1
        ends = {s: sorted(j for a, j in lattice.spans if a == s) for s in range(last + 1)}
        useful = {last}
        for a, j in sorted(lattice.spans, key=lambda s: -s[1]):
            if j in useful:
                useful.add(a)
        while i < last:
            ways = [j for j in ends[i] if j in useful]
            j = next((w for w in ways[:-1] if rng.random() < self.boundary), ways[-1])
            spans.append((i, j))
            i = j
        return spans, rng.integers(0, self.k, len(spans)).tolist()

    def resample(self, lattice: Lattice, spans: list[tuple[int, int]], kinds: list[int], model: Components, rng, heat: float | None) -> tuple[list[tuple[int, int]], list[int]]:
        """One blocked step for a pair; ``heat`` None takes the best instead."""
        for s, k in zip(spans, kinds):
            model.move(k, lattice.vectors[lattice.at[s]], -1.0)
        scores = lattice.scores(model, self.power)
        spans = lattice.best(scores) if heat is None else lattice.sample(scores / heat, rng.random)
        kinds = []
        for s in spans:
            e = lattice.vectors[lattice.at[s]]
            joint = model.log_joint(e)[0]
            if heat is None:
                k = int(joint.argmax())
            else:
                share = np.cumsum(np.exp((joint - joint.max()) / heat))
                k = int(np.searchsorted(share, rng.random() * share[-1], side="right").clip(0, self.k - 1))
            model.move(k, e, 1.0)
            kinds.append(k)
        return spans, kinds


_NAMES = ["pair_index", "x", "marks", "cuts", "kinds", "k", "n", "s"]


def _sweep(settings: Settings, turn: int, counts: tuple[np.ndarray, np.ndarray] | None, heat: float | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([settings.seed, turn, TaskContext.get().partitionId()])
        model = Components(*(c.copy() for c in counts), settings.var, settings.prior_var, settings.alpha) if counts else None
        n, s, schema = np.zeros(settings.k, np.int64), None, None
        for b in it:
            cuts, kinds = [], []
            old_cuts, old_kinds = (b.column(c).to_pylist() if counts else None for c in ("cuts", "kinds"))
            for r, (x, marks) in enumerate(zip(b.column("x"), b.column("marks").to_pylist())):
                lattice = settings.lattice(np.array(x.as_py(), float), marks)
                if not lattice.spans:
                    found = [], []
                elif counts is None:
                    found = settings.first(lattice, rng)
                else:
                    found = settings.resample(lattice, list(zip(old_cuts[r], old_cuts[r][1:])), old_kinds[r], model, rng, heat)
                cuts.append([0, *(j for _, j in found[0])] if found[0] else [0])
                kinds.append(found[1])
                for span, k in zip(*found):
                    e = np.rint(lattice.vectors[lattice.at[span]] * _UNIT).astype(np.int64)
                    s = np.zeros((settings.k, len(e)), np.int64) if s is None else s
                    n[k] += 1
                    s[k] += e
            rows = b.num_rows
            ints = pa.list_(pa.int32())
            out = [b.column("pair_index"), b.column("x"), b.column("marks"), pa.array(cuts, ints), pa.array(kinds, ints), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.list_(pa.int64()))]
            schema = [c.type for c in out]
            yield pa.RecordBatch.from_arrays(out, _NAMES)
        if s is not None:
            own = np.flatnonzero(n)
            out = [*(pa.nulls(len(own), t) for t in schema[:5]), pa.array(own, pa.int32()), pa.array(n[own], pa.int64()), pa.array(s[own].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, _NAMES)

    return run


def _exchanged(state: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Counts and sums of all partitions: k x dimensions numbers."""
    stats = state.where(F.col("k").isNotNull())
    counts = {r["k"]: r["n"] for r in stats.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # k rows
    if not counts:
        return None
    cells = stats.select("k", F.posexplode("s").alias("d", "v")).groupBy("k", "d").agg(F.sum("v").alias("v")).toArrow()
    at, dim, value = (cells.column(c).to_numpy() for c in ("k", "d", "v"))
    n, s = np.zeros(k), np.zeros((k, int(dim.max()) + 1))
    n[list(counts)] = list(counts.values())
    s[at, dim] = value / _UNIT
    return n, s


def sample_segments(pairs: DataFrame, k: int, n: int, var: float, sweeps: int, hottest: float = 1.0, per_part: int = 2048, **options) -> DataFrame:
    """``pair_index, seg, start, end, component``: the segments of every pair
    (``pair_index, x`` frames, ``marks`` landmarks; ``start`` and ``end`` in
    frames) after ``sweeps`` annealed rounds of sampling and one of best choices.

    ``k`` components over embeddings of ``n`` resampled frames. Pairs are dealt
    by hash to partitions of about ``per_part``; every round each partition
    sweeps all its pairs, starting from the counts and sums of all partitions,
    of which k x dimensions numbers reach the driver. The state of a round is a
    written table, so a lost executor repeats its tasks of one round; draws
    follow from (seed, round, partition), so repeats are equal. One partition
    is the sequential sampler. Other options: see ``Settings``.

    Empty pairs (fewer than two marks) have no segments.
    """
    settings = Settings(k, n, var, **options)
    rows = pairs.select("pair_index", "x", "marks")
    parts = max(1, -(-rows.count() // per_part))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("pair_index", "x", "marks")}
    shape = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", cuts array<int>, kinds array<int>, k int, n long, s array<long>"
    dealt = rows.repartition(parts, F.xxhash64("pair_index")).sortWithinPartitions("pair_index")
    state = keep(dealt.mapInArrow(_sweep(settings, 0, None, None), shape))
    for turn in range(1, sweeps + 2):
        counts = _exchanged(state, k)
        if counts is None:
            break
        heat = hottest + (1 - hottest) * (turn - 1) / max(sweeps - 1, 1) if turn <= sweeps else None
        texts = state.where(F.col("pair_index").isNotNull()).drop("k", "n", "s")
        state = keep(texts.mapInArrow(_sweep(settings, turn, counts, heat), shape))
    out = state.where(F.col("pair_index").isNotNull()).select("pair_index", "marks", "cuts", F.posexplode("kinds").alias("seg", "component"))
    at = lambda i: F.get("marks", F.get("cuts", i)).cast("long")
    return out.select("pair_index", F.col("seg").cast("long").alias("seg"), at(F.col("seg")).alias("start"), at(F.col("seg") + 1).alias("end"), F.col("component").cast("long").alias("component"))


def cut_posteriors(pairs: DataFrame, counts: tuple[np.ndarray, np.ndarray], n: int, var: float, heat: float = 1.0, **options) -> DataFrame:
    """``pair_index, mark, p``: probability of a cut at each landmark, summed
    over all segmentations, under components of the given counts and sums."""
    settings = Settings(len(counts[0]), n, var, **options)
    model = Components(*counts, settings.var, settings.prior_var, settings.alpha)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, mark, p = [], [], []
            for r, (x, marks) in enumerate(zip(b.column("x"), b.column("marks").to_pylist())):
                lattice = settings.lattice(np.array(x.as_py(), float), marks)
                post = lattice.cut_posteriors(lattice.scores(model, settings.power) / heat)
                at += [r] * len(marks)
                mark += marks
                p += post.tolist()
            yield pa.RecordBatch.from_arrays([b.column("pair_index").take(pa.array(at, pa.int64())), pa.array(mark, pa.int64()), pa.array(p, pa.float64())], ["pair_index", "mark", "p"])

    return pairs.select("pair_index", "x", "marks").mapInArrow(run, f"pair_index {pairs.schema['pair_index'].dataType.simpleString()}, mark long, p double")
