"""Variational correspondence models: regions with latent concepts, source
positions aligned to regions.

One kernel with switches: ``chain`` adds a Markov chain over the alignment;
the source side is ``tokens`` (a multinomial per concept) or ``frames`` (a
Gaussian mixture per concept); variances are fixed or re-estimated. Concepts
have a stick-breaking prior, alignments and mixtures Dirichlet ones. The
posterior of a pair is carried as columns of its row; an iteration maps rows to
new posteriors, then to partial sums of the hyper-parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.special import digamma, log_gaussian, logsumexp
from threadloom.sources.shared import release, stored

from .hmm import add_up, lists, nested, of_one_shape, picked, tie, viterbi


@dataclass
class Model:
    """Posterior hyper-parameters (counts) and observation models."""

    sticks: np.ndarray  # K x 2
    starts: dict[int, np.ndarray]  # by number of regions
    moves: dict[int, np.ndarray]
    mean_v: np.ndarray  # K x M x D
    var_v: np.ndarray
    mix_v: np.ndarray  # K x M
    tokens: np.ndarray | None = None  # K x V
    mean_a: np.ndarray | None = None  # K x M x Da
    var_a: np.ndarray | None = None
    mix_a: np.ndarray | None = None
    chain: bool = True
    free_variance: bool = False
    alpha: float = 1.0
    kappa: float = 1.0

    def concept_terms(self) -> np.ndarray:
        """Expected log stick weights."""
        total = digamma(self.sticks.sum(1))
        stay, go = digamma(self.sticks[:, 0]) - total, digamma(self.sticks[:, 1]) - total
        return stay + np.concatenate([[0.0], np.cumsum(go)[:-1]])

    @cached_property
    def logs(self) -> dict:
        """Expected log parameters, worked out once for all pairs."""
        e = lambda c: digamma(c) - digamma(c.sum(-1, keepdims=True))
        out = {"z": self.concept_terms(), "v": e(self.mix_v), "starts": {n: e(c) for n, c in self.starts.items()}, "moves": {n: e(c) for n, c in self.moves.items()}}
        w = self.sticks[:, 0] / self.sticks.sum(1)
        out["prior"] = np.log(np.maximum(w * np.concatenate([[1.0], np.cumprod(1 - w)[:-1]]), 1e-30))
        if self.tokens is not None:
            out["tokens"] = np.log(np.maximum(self.tokens, 1e-30))
        else:
            out["a"] = e(self.mix_a)
        return out


def source_terms(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """log p(x_t|z): (B, T, K); for frames the mixture terms (B, T, K, M) too."""
    if m.tokens is not None:
        return np.moveaxis(m.logs["tokens"][:, x.astype(int)], 0, -1), None
    zm = log_gaussian(x[..., None, None, :], m.mean_a, m.var_a) + m.logs["a"]
    return logsumexp(zm), zm


def region_terms(m: Model, y: np.ndarray) -> np.ndarray:
    """log p(y_i, mixture|z): (B, n, K, M)."""
    return log_gaussian(y[..., None, None, :], m.mean_v, m.var_v) + m.logs["v"]


def chain_posterior(start, move, e):
    """Posteriors (B, T, n) and move counts (B, n, n) of log-space
    chains with emissions ``e`` (B, T, n)."""
    _, t, n = e.shape
    a, b = np.empty(e.shape), np.zeros(e.shape)
    a[:, 0] = start + e[:, 0]
    for s in range(1, t):
        a[:, s] = logsumexp(a[:, s - 1, :, None] + move, 1) + e[:, s]
    for s in range(t - 1, 0, -1):
        b[:, s - 1] = logsumexp(move + (e[:, s] + b[:, s])[:, None, :], 2)
    post = a + b
    post = np.exp(post - logsumexp(post, 2, True))
    moves = np.zeros((len(e), n, n))
    for s in range(t - 1):
        j = a[:, s, :, None] + move + (e[:, s + 1] + b[:, s + 1])[:, None, :]
        moves += tie(np.exp(j - logsumexp(j.reshape(len(e), -1))[:, None, None]))
    return post, moves


def posterior(m: Model, x: np.ndarray, y: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Concept posterior (B, n, K) given the last alignment, then the alignment
    (B, T, n) given it, and expected moves (B, n, n)."""
    n = y.shape[1]
    sx, _ = source_terms(m, x)
    z = m.logs["z"] + np.swapaxes(align, 1, 2) @ sx + logsumexp(region_terms(m, y))
    z = np.exp(z - logsumexp(z, 2, True))
    e = sx @ np.swapaxes(z, 1, 2)
    if not m.chain:
        p = m.logs["starts"][n] + e
        return z, np.exp(p - logsumexp(p, 2, True)), np.zeros((len(y), n, n))
    post, moves = chain_posterior(m.logs["starts"][n], m.logs["moves"][n], e)
    return z, post, moves


def likelihood(m: Model, x: np.ndarray, y: np.ndarray, regions: np.ndarray | None = None) -> np.ndarray:
    """Log p(y) + log p(x|y) at the expected parameters, for each pair (B,).
    ``regions``: the ``region_terms``, if they are at hand."""
    ry = m.logs["prior"] + logsumexp(region_terms(m, y) if regions is None else regions)
    ly = logsumexp(ry)
    sx, _ = source_terms(m, x)
    e = logsumexp(sx[:, :, None, :] + (ry - ly[..., None])[:, None])
    n = y.shape[1]
    start = np.log(m.starts[n] / m.starts[n].sum())
    if not m.chain:
        return ly.sum(1) + logsumexp(start + e).sum(1)
    move = np.log(m.moves[n] / m.moves[n].sum(1, keepdims=True))
    a = start + e[:, 0]
    for s in range(1, e.shape[1]):
        a = logsumexp(a[:, :, None] + move, 1) + e[:, s]
    return ly.sum(1) + logsumexp(a)


def counts(m: Model, x, y, z, post, moves) -> dict[str, np.ndarray]:
    """Sums that a batch adds to the hyper-parameters and observation models."""
    n, k = y.shape[1], z.shape[2]
    r = region_terms(m, y)
    later = np.concatenate([np.cumsum(z[..., ::-1], 2)[..., ::-1][..., 1:], np.zeros((*z.shape[:2], 1))], 2)
    out = {"sticks": np.stack([z.sum((0, 1)), later.sum((0, 1))], 1), f"starts/{n}": post[:, 0].sum(0) if m.chain else post.sum((0, 1)), "n": np.array([float(len(y))]), "ll": np.array([likelihood(m, x, y, r).sum()])}
    if m.chain:
        out[f"moves/{n}"] = moves.sum(0)
    r = np.exp(r - logsumexp(r, -1, True)) * z[..., None]
    out["mix_v"], out["sum_v"] = r.sum((0, 1)), np.einsum("bnkm,bnd->kmd", r, y)
    if m.free_variance:
        out["sq_v"] = np.einsum("bnkm,bnkmd->kmd", r, (y[..., None, None, :] - m.mean_v) ** 2)
    za = post @ z  # (B, T, K)
    if m.tokens is not None:
        out["tokens"] = np.stack([np.bincount(x.astype(int).ravel(), za[..., c].ravel(), minlength=m.tokens.shape[1]) for c in range(k)])
    else:
        _, zm = source_terms(m, x)
        q = np.exp(zm - logsumexp(zm, -1, True)) * za[..., None]
        out["mix_a"], out["sum_a"] = q.sum((0, 1)), np.einsum("btkm,btd->kmd", q, x)
        if m.free_variance:
            out["sq_a"] = np.einsum("btkm,btkmd->kmd", q, (x[..., None, None, :] - m.mean_a) ** 2)
    return out


def update(m: Model, s: dict[str, np.ndarray]) -> Model:
    """Conjugate updates and weighted means (shrunk to the old mean by
    ``kappa`` observations)."""
    k = len(m.sticks)
    new = replace(m, sticks=s["sticks"].reshape(k, 2) + np.array([1.0, m.alpha]))
    new.starts = {n: 1.0 + s.get(f"starts/{n}", np.zeros(n)) for n in m.starts}
    new.moves = {n: 1.0 + s.get(f"moves/{n}", np.zeros(n * n)).reshape(n, n) for n in m.moves}
    for side in ("v", "a"):
        if f"mix_{side}" not in s:
            continue
        mix, old = s[f"mix_{side}"].reshape(k, -1), getattr(m, f"mean_{side}")
        mean = (s[f"sum_{side}"].reshape(old.shape) + m.kappa * old) / (mix[..., None] + m.kappa)
        setattr(new, f"mix_{side}", 1.0 + mix)
        setattr(new, f"mean_{side}", mean)
        if m.free_variance:
            var = (s[f"sq_{side}"].reshape(old.shape) + m.kappa * getattr(m, f"var_{side}")) / (mix[..., None] + m.kappa)
            setattr(new, f"var_{side}", np.maximum(var, 1e-4))
    if m.tokens is not None:
        t = s["tokens"].reshape(m.tokens.shape) + 0.1
        new.tokens = t / t.sum(1, keepdims=True)
    return new


_STATE = "pair_index long, x array<double>, xd int, y array<array<double>>, align array<double>, z array<double>, moves array<double>"


_NAMES = ["pair_index", "x", "xd", "y", "align", "z", "moves"]


def _shapes(b: pa.RecordBatch):
    """Rows of equal shape as stacked arrays: ids, xd, x, y, align, z, moves."""
    ids, wide = (b.column(c).to_numpy(zero_copy_only=False) for c in ("pair_index", "xd"))
    (nx, fx, xs), (ny, fy, ys), (_, fa, aligns), (nz, fz, zs), (nm, fm, ms) = (nested(b.column(c)) for c in ("x", "y", "align", "z", "moves"))
    for (size, xd, n, of_z, of_m), every in of_one_shape(nx, wide, ny, nz, nm):
        t = size // xd if xd else size
        for lo in range(0, len(every), 512):
            rows = every[lo : lo + 512]
            x = picked(fx[rows], size, xs)
            x = x if xd == 0 else x.reshape(len(x), t, xd)
            z, moves = picked(fz[rows], of_z, zs).reshape(len(rows), n, -1) if of_z else None, picked(fm[rows], of_m, ms).reshape(-1, n, n) if of_m else None
            yield ids[rows], xd, x, picked(fy[rows], n, ys), picked(fa[rows], t * n, aligns).reshape(-1, t, n), z, moves


def _listed(v: np.ndarray) -> pa.ListArray:
    """Rows of an array as lists, of lists if there are three axes."""
    if v.ndim == 3:
        inner = lists(np.full(v.shape[0] * v.shape[1], v.shape[2]), v.ravel(), pa.float64())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), inner)
    return lists(np.full(len(v), v.shape[1]), v.ravel(), pa.float64())


def _step(sent):
    def run(it):
        m = sent.value
        for b in it:
            for ids, xd, x, y, align, _, _ in _shapes(b):
                z, post, moves = posterior(m, x, y, align)
                flat = lambda v: _listed(v.reshape(len(v), -1))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), flat(x), pa.array(np.full(len(ids), xd), pa.int32()), _listed(y), flat(post), flat(z), flat(moves)], _NAMES)

    return run


def begin(pairs: DataFrame, frames: bool) -> DataFrame:
    """Rows with uniform alignments. ``x``: token ids, or frames (arrays)."""
    t, n = F.size("x"), F.size("y")
    flat = F.flatten("x") if frames else F.col("x").cast("array<double>")
    xd = F.size(F.get("x", 0)) if frames else F.lit(0)
    none = F.array().cast("array<double>")
    return pairs.where((t > 0) & (n > 0)).select("pair_index", flat.alias("x"), xd.cast("int").alias("xd"), F.col("y").cast("array<array<double>>").alias("y"), F.array_repeat(1 / n, t * n).alias("align"), none.alias("z"), none.alias("moves"))


def train(pairs: DataFrame, m: Model, iterations: int) -> tuple[Model, DataFrame, list[float]]:
    """(model, posterior rows, mean log-likelihood before each update)."""
    rows, history = begin(pairs, m.tokens is None), []
    for _ in range(iterations):
        sent = pairs.sparkSession.sparkContext.broadcast(m)
        before, rows = rows, stored(rows.mapInArrow(_step(sent), _STATE))
        release(before)

        def stats(b, sent=sent):
            for _, _, x, y, align, z, moves in _shapes(b):
                yield counts(sent.value, x, y, z, align, moves)

        s = add_up(rows, stats)
        history.append(float(s["ll"][0] / s["n"][0]))
        m = update(m, s)
    return m, rows, history


def staged(pairs: DataFrame, stages: list[DataFrame], m: Model, iterations: int) -> tuple[Model, DataFrame, list[float]]:
    """A curriculum; every stage trains on its pairs, the last on ``pairs``."""
    history = []
    for part in [*stages, pairs]:
        m, rows, h = train(part, m, iterations)
        history += h
    return m, rows, history


def decode(rows: DataFrame, m: Model) -> DataFrame:
    """``pair_index, alignment, concepts``: Viterbi over the chain (or the best
    region of each position), and the best concept of each region."""
    sent = rows.sparkSession.sparkContext.broadcast(m)

    def run(it):
        m = sent.value
        for b in it:
            for ids, _, x, y, align, z, _ in _shapes(b):
                n = y.shape[1]
                if m.chain:
                    e = source_terms(m, x)[0] @ np.swapaxes(z, 1, 2)
                    path = viterbi(m.starts[n] / m.starts[n].sum(), m.moves[n] / m.moves[n].sum(1, keepdims=True), np.exp(e - e.max(2, keepdims=True)))
                else:
                    path = align.argmax(2)
                best = lambda v: lists(np.full(len(v), v.shape[1]), v.ravel(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), best(path), best(z.argmax(2))], ["pair_index", "alignment", "concepts"])

    return rows.mapInArrow(run, "pair_index long, alignment array<int>, concepts array<int>")


def start(lengths: list[int], k: int, means: np.ndarray, var: float, v: int = 0, means_a: np.ndarray | None = None, var_a: float = 1.0, **kw) -> Model:
    """``means``: K x M x D of the regions; ``v`` tokens or ``means_a`` frames."""
    mixed = lambda x: np.ones(x.shape[:2])
    return Model(np.ones((k, 2)), {n: np.ones(n) for n in lengths}, {n: np.ones((n, n)) for n in lengths}, means, np.full(means.shape, var), mixed(means), np.full((k, v), 1 / v) if v else None, means_a, np.full(means_a.shape, var_a) if means_a is not None else None, mixed(means_a) if means_a is not None else None, **kw)
