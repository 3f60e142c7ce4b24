"""Alignment HMMs: target positions are states, each with a latent concept.

One kernel serves the whole family. It works on batches of pairs with the same
number of targets (B pairs, N source positions in all, m targets, K concepts),
pairs along the last axis and positions step by step (``Steps``), so that pairs of
any length advance together:

* concept model p(z|y): ``table`` (given), ``linear`` softmax, ``rbf`` softmax,
  ``mlp`` (one ReLU layer) over target vectors; integers stand for one-hot
  vectors, and with an identity table the concept of a state is known;
* emission p(x|z): ``unigram`` or ``bigram`` over token ids, or ``phones``: a
  latent phone with p(phone|frame) linear or RBF and p(phone|z) a table.

Staying in a state keeps its concept; moving draws a new one. Recursions are
scaled, so long sources don't underflow. Spark carries the data: every iteration
maps batches to partial sums of the expected counts, adds them up by key, and
only sums as large as the parameters reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the floor of expected counts.
EPS = 1e-50


def tie_jumps(counts: DataFrame, value: str) -> DataFrame:
    """Counts of (m, i, j) replaced by the sum over equal jumps j - i."""
    w = Window.partitionBy("m", F.col("j") - F.col("i"))
    return counts.withColumn(value, F.sum(value).over(w))


def tie(c: np.ndarray) -> np.ndarray:
    """The same for a matrix (or a stack of matrices)."""
    m = c.shape[-1]
    out = np.empty_like(c)
    for jump in range(1 - m, m):
        i = np.arange(max(0, -jump), min(m, m - jump))
        out[..., i, i + jump] = c[..., i, i + jump].sum(-1, keepdims=True)
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def with_one(v: np.ndarray) -> np.ndarray:
    return np.concatenate([v, np.ones((*v.shape[:-1], 1))], -1)


@dataclass
class Params:
    """``init[m]``, ``trans[m]``; ``obs``: K x V, K x V x V (previous token
    first) or K x P; ``concept`` and ``phone``: weights of the two classifiers."""

    init: dict[int, np.ndarray]
    trans: dict[int, np.ndarray]
    obs: np.ndarray
    concept: dict[str, np.ndarray] = field(default_factory=dict)
    phone: dict[str, np.ndarray] = field(default_factory=dict)
    first: np.ndarray | None = None
    concept_kind: str = "linear"
    phone_kind: str = "linear"
    emission: str = "unigram"
    width: float = 1.0

    def chain(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        if m in self.init:
            return self.init[m], self.trans[m]
        return np.full(m, 1 / m), np.full((m, m), 1 / m)


def inputs(kind: str, w: dict[str, np.ndarray]) -> int:
    """Width of a classifier's vectors."""
    return {"table": lambda: len(w["p"]), "linear": lambda: w["W"].shape[1] - 1, "rbf": lambda: w["mu"].shape[1], "mlp": lambda: w["W1"].shape[1] - 1}[kind]()


def classify(kind: str, w: dict[str, np.ndarray], v: np.ndarray, width: float) -> np.ndarray:
    """p(class|vector) for the last axis of ``v``; ``table``: v is it already.
    Integers are the places of the ones in one-hot vectors."""
    if v.dtype.kind in "iu":
        return classify(kind, w, np.eye(inputs(kind, w)), width)[v]
    if kind == "table":
        return v @ w["p"] if "p" in w else v
    if kind == "linear":
        return softmax(with_one(v) @ w["W"].T)
    if kind == "rbf":
        return softmax(-((v[..., None, :] - w["mu"]) ** 2).sum(-1) / width)
    if kind == "mlp":
        return softmax(with_one(np.maximum(with_one(v) @ w["W1"].T, 0)) @ w["W2"].T)
    raise ValueError(kind)


def classifier_gradient(kind: str, w: dict[str, np.ndarray], v: np.ndarray, diff: np.ndarray, width: float) -> dict[str, np.ndarray]:
    """Sum over rows of the gradient of the expected log-likelihood; ``diff`` is
    posterior minus prediction. It is linear in ``diff``, which for integers is
    first added up by vector."""
    diff = diff.reshape(-1, diff.shape[-1])
    if v.dtype.kind in "iu":
        d = inputs(kind, w)
        v, diff = np.eye(d), np.stack([np.bincount(v.ravel(), c, minlength=d) for c in diff.T], 1)
    v = v.reshape(-1, v.shape[-1])
    if kind == "linear":
        return {"W": diff.T @ with_one(v)}
    if kind == "rbf":
        return {"mu": 2 / width * (diff.T @ v - diff.sum(0)[:, None] * w["mu"])}
    if kind == "mlp":
        z = with_one(v) @ w["W1"].T
        back = (diff @ w["W2"][:, :-1]) * (z > 0)
        return {"W1": back.T @ with_one(v), "W2": diff.T @ with_one(np.maximum(z, 0))}
    return {}


class Steps:
    """Rows of any lengths step by step: rows in falling order of length, so those
    with a step t are the first ``n[t]``, and (t, row) is at ``at[t] + row``."""

    def __init__(self, lengths: np.ndarray):
        self.n = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        self.at = np.cumsum(self.n) - self.n
        self.step = np.repeat(np.arange(len(self.n)), self.n)
        self.row = np.arange(len(self.step)) - self.at[self.step]
        self.rows = len(lengths)

    def before(self) -> np.ndarray:
        """The place one step earlier of all places but those of the first step."""
        return self.at[self.step[self.rows :] - 1] + self.row[self.rows :]


def emitted(p: Params, s: Steps, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """p(x_t|z): (1, K, N), and for ``phones`` p(phone|frame): (N, P)."""
    if p.emission == "unigram":
        return np.take(p.obs, x, 1)[None], None
    if p.emission == "bigram":
        k, v, _ = p.obs.shape
        return np.concatenate([np.take(p.first, x[: s.rows], 1), np.take(p.obs.reshape(k, -1), x[s.before()] * v + x[s.rows :], 1)], 1)[None], None
    q = classify(p.phone_kind, p.phone, x, p.width)
    return (p.obs @ q.T)[None], q


def known(p: Params, y: np.ndarray) -> bool:
    """Whether every state has one concept, which ``y`` names."""
    return p.concept_kind == "table" and y.dtype.kind in "iu" and p.emission == "unigram" and np.array_equal(p.concept["p"], np.eye(len(p.obs)))


def prior(p: Params, y: np.ndarray) -> np.ndarray:
    """p(z|y): (m, K, B), pairs next to each other in memory."""
    return np.ascontiguousarray(np.moveaxis(classify(p.concept_kind, p.concept, y, p.width), 0, -1))


def densities(p: Params, s: Steps, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(p(z|y): (m, K, B), p(x_t|z): (1, K, N), p(phone|frame)). Known concepts are
    left out: one concept, with emissions by state (m, 1, N)."""
    if known(p, y):
        return np.ones((y.shape[1], 1, len(y))), p.obs[y.T[:, s.row], x][:, None], None
    return prior(p, y), *emitted(p, s, x)


def forward_steps(init, trans, pz, px, s: Steps):
    """Scaled alpha (m, K, N) and scales (N)."""
    a, c = np.empty((*pz.shape[:2], len(s.row))), np.empty(len(s.row))
    stay = np.diag(trans)
    move = (trans - np.diag(stay)).T
    for t, (lo, n) in enumerate(zip(s.at, s.n, strict=True)):
        if t == 0:
            now = init[:, None, None] * pz
        else:
            last = a[..., s.at[t - 1] : s.at[t - 1] + n]
            now = stay[:, None, None] * last + (move @ last.sum(1))[:, None] * pz[..., :n]
        now *= px[..., lo : lo + n]
        c[lo : lo + n] = np.maximum(now.sum((0, 1)), 1e-300)
        a[..., lo : lo + n] = now / c[lo : lo + n]
    return a, c


def backward_steps(trans, pz, px, c, s: Steps):
    """Beta scaled by the same scales; sum of alpha * beta is 1 at every t."""
    out = np.ones((*pz.shape[:2], len(s.row)))
    stay = np.diag(trans)
    move = trans - np.diag(stay)
    for t in range(len(s.n) - 1, 0, -1):
        lo, n = s.at[t], s.n[t]
        seen = out[..., lo : lo + n] * px[..., lo : lo + n]
        drawn = move @ (pz[..., :n] * seen).sum(1)
        out[..., s.at[t - 1] : s.at[t - 1] + n] = (stay[:, None, None] * seen + drawn[:, None]) / c[lo : lo + n]
    return out


def transition_sums(trans, pz, px, a, be, tied: bool, s: Steps):
    """Expected moves (m, m) summed over pairs; each step is normalised. The
    floor of a step's moves is below rounding unless the whole step is tiny."""
    stay = np.diag(trans)
    move = trans - np.diag(stay)
    seen = (be * px)[..., s.rows :]
    start = np.take(a, s.before(), -1)
    own = stay[:, None] * (start * seen).sum(1)
    start, end = start.sum(1), (np.take(pz, s.row[s.rows :], -1) * seen).sum(1)
    whole = (start * (move @ end)).sum(0) + own.sum(0)
    plain = whole > 1e-30
    share = np.divide(1.0, whole, out=np.zeros_like(whole), where=plain)
    total = (start * share) @ end.T * move + np.diag(own @ share)
    if not plain.all():
        step = start[:, None, ~plain] * move[..., None] * end[None][..., ~plain]
        step[np.arange(len(move)), np.arange(len(move))] += own[:, ~plain]
        step = np.maximum(step, EPS)
        total += (step / step.sum((0, 1))).sum(-1)
    return tie(total) if tied else total


def concept_posterior_steps(init, trans, pz, px, s: Steps):
    """p(z_i|x, y) (m, K, B), by clamping each concept of each state in turn
    in the chain whose emissions mix the concepts at every step. All clamped
    chains advance together; only the messages of one step are held."""
    m, k, rows = pz.shape
    px = px[0]
    mixed = (np.take(pz, s.row, -1) * px).sum(1)
    a = np.empty((m, k, m, rows))
    a[:] = init[:, None] * mixed[:, :rows]
    for i in range(m):
        a[i, :, i] = init[i] * px[:, :rows]
    for lo, n in zip(s.at[1:], s.n[1:], strict=True):
        now = np.matmul(trans.T, a[..., :n])
        clamped = [now[i, :, i] * px[:, lo : lo + n] for i in range(m)]
        now *= mixed[:, lo : lo + n]
        for i in range(m):
            now[i, :, i] = clamped[i]
        now /= np.maximum(now.max((0, 1, 2)), 1e-300)
        a[..., :n] = now
    p = np.maximum(pz * a.sum(2), EPS)
    return p / p.sum(1, keepdims=True)


def viterbi_steps(init, trans, em, s: Steps):
    """Best state paths (N) for emissions (m, N), in log space; ties to the
    lower state."""
    with np.errstate(divide="ignore"):
        le, lt = np.log(em), np.log(trans)
        score = np.log(init)[:, None] + le[:, : s.rows]
    back, path = np.zeros(em.shape, np.int32), np.empty(em.shape[1], np.int64)
    for lo, n in zip(s.at[1:], s.n[1:], strict=True):
        best, of = score[0, :n] + lt[0][:, None], back[:, lo : lo + n]
        for i in range(1, len(init)):
            other = score[i, :n] + lt[i][:, None]
            of[other > best] = i
            np.maximum(best, other, out=best)
        score[:, :n] = best + le[:, lo : lo + n]
    now = score.argmax(0)
    for t in range(len(s.n) - 1, -1, -1):
        lo, n = s.at[t], s.n[t]
        path[lo : lo + n] = now[:n]
        now[:n] = back[now[:n], np.arange(lo, lo + n)]
    return path


def cluster_steps(pz, px, path, s: Steps):
    """Concept of each state given the path (m, B): prior times emissions."""
    m, k, rows = pz.shape
    with np.errstate(divide="ignore"):
        score, lp = np.log(pz), np.log(px[0])
    lp = np.where(np.isfinite(lp), lp, -700)
    for z in range(k):
        score[:, z] += np.bincount(path * rows + s.row, lp[z], minlength=m * rows).reshape(m, rows)
    return score.argmax(1)


def _level(b: int, t: int) -> Steps:
    return Steps(np.full(b, t))


def _by_step(v: np.ndarray) -> np.ndarray:
    """(B, T, ...) as (T * B, ...)."""
    return v.swapaxes(0, 1).reshape(-1, *v.shape[2:])


def _by_row(v: np.ndarray, b: int) -> np.ndarray:
    """(..., T * B) as (B, T, ...)."""
    return np.moveaxis(v.reshape(*v.shape[:-1], -1, b), (-1, -2), (0, 1))


def emissions(p: Params, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """For rows of equal length, as the functions below: p(x_t|z): (B, T, K), and
    for ``phones`` p(phone|frame): (B, T, P)."""
    px, q = emitted(p, _level(*x.shape[:2]), _by_step(x))
    return _by_row(px[0], len(x)), q if q is None else _by_row(q.T, len(x))


def _last(pz, px):
    return np.moveaxis(pz, 0, -1), _by_step(px).T[None], _level(*px.shape[:2])


def forward(init, trans, pz, px):
    """Scaled alpha (B, T, m, K) and scales (B, T)."""
    a, c = forward_steps(init, trans, *_last(pz, px))
    return _by_row(a, len(px)), _by_row(c, len(px))


def backward(trans, pz, px, c):
    """Beta (B, T, m, K)."""
    z, x, s = _last(pz, px)
    return _by_row(backward_steps(trans, z, x, _by_step(c), s), len(px))


def transition_counts(trans, pz, px, a, be, tied: bool):
    """Expected moves (m, m)."""
    z, x, s = _last(pz, px)
    a, be = (np.moveaxis(_by_step(v), 0, -1) for v in (a, be))
    return transition_sums(trans, z, x, a, be, tied, s)


def concept_posterior(init, trans, pz, px):
    """p(z_i|x, y): (B, m, K)."""
    return np.moveaxis(concept_posterior_steps(init, trans, *_last(pz, px)), -1, 0)


def viterbi(init, trans, em):
    """Best paths (B, T) for emissions (B, T, m)."""
    return _by_row(viterbi_steps(init, trans, _by_step(em).T, _level(*em.shape[:2])), len(em))


def expected_counts(p: Params, s: Steps, x: np.ndarray, y: np.ndarray, tied: bool = False, all_steps: bool = False) -> dict[str, np.ndarray]:
    """Sums over a batch with m targets each. ``all_steps`` counts initial states
    at every step, as an older variant of the update does."""
    m = y.shape[1]
    init, trans = p.chain(m)
    pz, px, q = densities(p, s, x, y)
    a, c = forward_steps(init, trans, pz, px, s)
    be = backward_steps(trans, pz, px, c, s)
    g = a * be
    g /= np.maximum(g.sum((0, 1)), EPS)
    states = g.sum(1)
    out = {f"init/{m}": (states if all_steps else states[:, : s.rows]).sum(1), f"trans/{m}": transition_sums(trans, pz, px, a, be, tied, s), "ll": np.array([np.log(c).sum()]), "n": np.array([float(s.rows)])}
    z = g.sum(0)  # K05: (K, N)
    k, v = len(p.obs), p.obs.shape[-1]
    if known(p, y):
        out["obs"] = np.bincount((y.T[:, s.row] * v + x).ravel(), states.ravel(), minlength=k * v).reshape(k, v)
    elif p.emission == "unigram":
        out["obs"] = np.stack([np.bincount(x, w, minlength=v) for w in z])
    elif p.emission == "bigram":
        out["first"] = np.stack([np.bincount(x[: s.rows], w[: s.rows], minlength=v) for w in z])
        code = x[s.before()] * v + x[s.rows :]
        out["obs"] = np.stack([np.bincount(code, w[s.rows :], minlength=v * v) for w in z])
    else:
        joint = z.T[..., None] * q[:, None, :] * p.obs / np.maximum(px[0].T[..., None], EPS)  # (N, K, P)
        out["obs"] = joint.sum(0)
        for name, grad in classifier_gradient(p.phone_kind, p.phone, x, joint.sum(1) - q, p.width).items():
            out[f"phone/{name}"] = grad
    if p.concept_kind != "table":
        post = concept_posterior_steps(init, trans, pz, px, s)
        for name, grad in classifier_gradient(p.concept_kind, p.concept, y, np.moveaxis(post - pz, -1, 0), p.width).items():
            out[f"concept/{name}"] = grad
    return out


def update(p: Params, s: dict[str, np.ndarray], rate: float, momentum: float = 0.0, floor: float = 1e-12) -> Params:
    """M-step: counts normalised, classifiers moved along their mean gradient."""
    norm = lambda c: (c + floor) / (c + floor).sum(-1, keepdims=True)
    init = {int(k[5:]): norm(v) for k, v in s.items() if k.startswith("init/")}
    trans = {int(k[6:]): norm(v.reshape(int(k[6:]), -1)) for k, v in s.items() if k.startswith("trans/")}
    step = lambda w, kind: {n: (1 - momentum) * v + rate * s[f"{kind}/{n}"].reshape(v.shape) / s["n"][0] if f"{kind}/{n}" in s else v for n, v in w.items()}
    return replace(p, init=init, trans=trans, obs=norm(s["obs"].reshape(p.obs.shape)), first=norm(s["first"].reshape(p.first.shape)) if p.first is not None else None, concept=step(p.concept, "concept"), phone=step(p.phone, "phone"))


def nested(c: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A column of lists as (lengths, first places, values) without a Python
    object a value; null counts as empty. Lists of vectors: values are rows."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    n = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    v = c.flatten()
    if pa.types.is_list(v.type):
        width = v.value_lengths().to_numpy(zero_copy_only=False)
        if len(width) and (width != width[0]).any():
            raise ValueError("vectors of different lengths")
        v = v.flatten().to_numpy(zero_copy_only=False).reshape(len(width), -1 if len(width) else 0)
    else:
        v = v.to_numpy(zero_copy_only=False)
    return n, np.cumsum(n) - n, v.astype(np.int64) if v.dtype.kind in "iu" else v


def picked(first: np.ndarray, length: int, values: np.ndarray) -> np.ndarray:
    """The lists that begin at ``first``, all of one length, stacked."""
    return values[first[:, None] + np.arange(length)]


def lists(n: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The reverse of ``nested``: lists of lengths ``n``, one after another."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values, kind))


def of_one_shape(*lengths: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(shape, row numbers in order) of the rows with the same lengths."""
    if not len(lengths[0]):
        return
    order = np.lexsort((np.arange(len(lengths[0])), *lengths[::-1]))
    at = np.stack([n[order] for n in lengths], 1)
    for rows in np.split(order, np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1):
        yield tuple(int(n[rows[0]]) for n in lengths), rows


#: Rows that advance together at most: the arrays of a step stay in the cache.
ROWS = 2048


def batches(b: pa.RecordBatch, concepts: int = 64, most_bytes: int = 128 << 20) -> Iterator[tuple[np.ndarray, Steps, np.ndarray, np.ndarray]]:
    """(row numbers, steps, x by step, y) of the rows of a batch with the same
    number of targets; as many at once as keep the largest arrays of the kernels
    (T x m x K and m x K x m a row, K up to ``concepts``) within ``most_bytes``, one
    row at least. Integer ``y`` stay as they are."""
    nx, fx, xs = nested(b.column("x"))
    ny, fy, ys = nested(b.column("y"))
    order = np.lexsort((-nx, ny))
    order = order[(nx[order] > 0) & (ny[order] > 0)]
    for rows in np.split(order, np.flatnonzero(np.diff(ny[order])) + 1) if len(order) else ():
        m = int(ny[rows[0]])
        size = np.cumsum(8 * (nx[rows] + m) * m * concepts)
        lo = 0
        while lo < len(rows):
            hi = int(np.searchsorted(size, most_bytes + (size[lo - 1] if lo else 0), "right"))
            part = rows[lo : max(lo + 1, min(hi, lo + ROWS))]
            s = Steps(nx[part])
            y = picked(fy[part], m, ys)
            yield part, s, xs[fx[part][s.row] + s.step], y if y.dtype.kind in "iu" and y.ndim == 2 else y.astype(float)
            lo += len(part)


def add_up(df: DataFrame, stats) -> dict[str, np.ndarray]:
    """Partial sums of every partition added by key; as many numbers as there
    are parameters reach the driver."""

    def run(it):
        total: dict[str, np.ndarray] = {}
        for b in it:
            for part in stats(b):
                for k, v in part.items():
                    total[k] = total[k] + v if k in total else np.asarray(v, float)
        names = [k for k, v in total.items() for _ in range(v.size)]
        index = np.concatenate([np.arange(v.size) for v in total.values()]) if total else np.zeros(0, np.int64)
        value = np.concatenate([v.ravel() for v in total.values()]) if total else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(index, pa.int64()), pa.array(value, pa.float64())], ["k", "i", "v"])

    sums = df.mapInArrow(run, "k string, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toArrow()
    key, index, value = sums["k"].combine_chunks().dictionary_encode(), sums["i"].to_numpy(), sums["v"].to_numpy()
    code = key.indices.to_numpy()
    order = np.lexsort((index, code))
    ends = np.cumsum(np.bincount(code, minlength=len(key.dictionary)))
    parts = np.split(value[order], ends[:-1]) if len(ends) else []
    return dict(sorted(zip(key.dictionary.to_pylist(), parts, strict=True)))


def train(pairs: DataFrame, p: Params, iterations: int, rate: float = 1.0, momentum: float = 0.0, tied: bool = False, all_steps: bool = False) -> tuple[Params, list[float]]:
    """EM over ``pairs`` (``x``: token ids or frames, ``y``: target vectors);
    returns the parameters and the mean log-likelihood before each update.
    The rate falls tenfold every ten iterations."""
    history = []
    for n in range(iterations):
        sent = pairs.sparkSession.sparkContext.broadcast(p)
        s = add_up(pairs, lambda b, sent=sent: (expected_counts(sent.value, s, x, y, tied, all_steps) for _, s, x, y in batches(b)))
        history.append(float(s["ll"][0] / s["n"][0]))
        p = update(p, s, rate / 10 ** (n // 10), momentum)
    return p, history


def state_posteriors(pairs: DataFrame, p: Params) -> DataFrame:
    """``pair_index, pos, state, post`` and the pair's ``ll``."""
    sent = pairs.sparkSession.sparkContext.broadcast(p)

    def run(it):
        for b in it:
            p, ids = sent.value, b.column("pair_index").to_numpy(zero_copy_only=False)
            for rows, s, x, y in batches(b):
                init, trans = p.chain(y.shape[1])
                pz, px, _ = densities(p, s, x, y)
                a, c = forward_steps(init, trans, pz, px, s)
                g = (a * backward_steps(trans, pz, px, c, s)).sum(1)
                ll = np.bincount(s.row, np.log(c))
                m, at = len(g), np.tile(s.row, len(g))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows][at]), pa.array(np.tile(s.step, m)), pa.array(np.repeat(np.arange(m), len(s.row))), pa.array(g.ravel()), pa.array(ll[at])], ["pair_index", "pos", "state", "post", "ll"])

    return pairs.select("pair_index", "x", "y").mapInArrow(run, "pair_index long, pos long, state long, post double, ll double")


def decode(pairs: DataFrame, p: Params) -> DataFrame:
    """``pair_index, alignment, concepts``: Viterbi path and concept of each target."""
    sent = pairs.sparkSession.sparkContext.broadcast(p)

    def run(it):
        for b in it:
            p = sent.value
            nx, ny = (nested(b.column(c))[0] for c in ("x", "y"))
            some = (nx > 0) & (ny > 0)
            nx, ny = nx * some, ny * some
            fx, fy = np.cumsum(nx) - nx, np.cumsum(ny) - ny
            path, kind = np.empty(nx.sum(), np.int32), np.empty(ny.sum(), np.int32)
            for rows, s, x, y in batches(b):
                init, trans = p.chain(y.shape[1])
                pz, px, _ = densities(p, s, x, y)
                best = viterbi_steps(init, trans, (np.take(pz, s.row, -1) * px).sum(1), s)
                path[fx[rows][s.row] + s.step] = best
                kind[fy[rows][:, None] + np.arange(y.shape[1])] = y if known(p, y) else cluster_steps(pz, px, best, s).T
            yield pa.RecordBatch.from_arrays([b.column("pair_index"), lists(nx, path, pa.int32()), lists(ny, kind, pa.int32())], ["pair_index", "alignment", "concepts"])

    return pairs.select("pair_index", "x", "y").mapInArrow(run, "pair_index long, alignment array<int>, concepts array<int>")


def start(lengths: list[int], k: int, v: int, dim: int, kind: str = "linear", emission: str = "unigram", hidden: int = 8, phones: int = 0, frame_dim: int = 0, phone_kind: str = "linear", seed: int = 0, width: float = 1.0) -> Params:
    """Seeded start: uniform chains, near-uniform emissions, small weights."""
    r = np.random.default_rng(seed)
    noisy = lambda *s: (x := 1 + 0.1 * r.random(s)) / x.sum(-1, keepdims=True)
    w = {"linear": lambda d, c: {"W": r.normal(0, 0.1, (c, d + 1))}, "rbf": lambda d, c: {"mu": r.normal(0, 0.5, (c, d))}, "mlp": lambda d, c: {"W1": r.normal(0, 0.5, (hidden, d + 1)), "W2": r.normal(0, 0.5, (c, hidden + 1))}, "table": lambda d, c: {"p": np.eye(d)}}
    obs = noisy(k, v, v) if emission == "bigram" else noisy(k, phones if emission == "phones" else v)
    return Params({m: np.full(m, 1 / m) for m in lengths}, {m: np.full((m, m), 1 / m) for m in lengths}, obs, w[kind](dim, k), w[phone_kind](frame_dim, phones) if emission == "phones" else {}, noisy(k, v) if emission == "bigram" else None, kind, phone_kind, emission, width)


def anneal(pairs: DataFrame, p: Params, jumps: int, iterations: int, temperature: float, seed: int = 0, **kw) -> tuple[Params, list[float]]:
    """Perturb the concept weights, train a little, accept by Boltzmann's
    rule at temperature T0 / log(k + 2)."""
    r = np.random.default_rng(seed)
    best, history = train(pairs, p, iterations, **kw)
    at = [history[-1]]
    for k in range(jumps):
        moved = replace(best, concept={n: v + r.normal(0, 0.1, v.shape) for n, v in best.concept.items()})
        tried, h = train(pairs, moved, iterations, **kw)
        if h[-1] >= at[-1] or r.random() < np.exp((h[-1] - at[-1]) / (temperature / np.log(k + 2))):
            best = tried
            at.append(h[-1])
        else:
            at.append(at[-1])
    return best, at


def baum_welch(sequences: DataFrame, states: int, symbols: int, iterations: int, seed: int = 0, obs: np.ndarray | None = None) -> tuple[Params, list[float]]:
    """A discrete left-to-right HMM over ``x`` (token ids): the alignment
    HMM with one fixed concept per state. ``obs``: first emissions, else seeded."""
    p = start([states], states, symbols, states, "table", seed=seed)
    p.obs = p.obs if obs is None else obs
    left = np.triu(np.ones((states, states)))
    p.trans[states] = left / left.sum(1, keepdims=True)
    eye = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(states)]) for i in range(states)])
    return train(sequences.withColumn("y", eye), p, iterations)


def concept_posteriors(pairs: DataFrame, p: Params) -> DataFrame:
    """``pair_index, state, concept, prior, post`` of every target of every
    pair: its prediction, and the posterior given the pair's source."""
    sent = pairs.sparkSession.sparkContext.broadcast(p)
    names = ["pair_index", "state", "concept", "prior", "post"]

    def run(it):
        for b in it:
            p, ids = sent.value, b.column("pair_index").to_numpy(zero_copy_only=False)
            for rows, s, x, y in batches(b):
                init, trans = p.chain(y.shape[1])
                pz = prior(p, y)
                post = np.moveaxis(concept_posterior_steps(init, trans, pz, emitted(p, s, x)[0], s), -1, 0)
                pz = np.moveaxis(pz, -1, 0)
                at = np.indices(post.shape).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows][at[0]]), pa.array(at[1]), pa.array(at[2]), pa.array(pz.ravel()), pa.array(post.ravel())], names)

    return pairs.select("pair_index", "x", "y").mapInArrow(run, "pair_index long, state long, concept long, prior double, post double")


def concept_gradient(pairs: DataFrame, p: Params) -> dict[str, np.ndarray]:
    """The gradient of the expected log-likelihood in the weights of the
    concept model, summed over all targets of all pairs."""
    sent = pairs.sparkSession.sparkContext.broadcast(p)

    def stats(b):
        p = sent.value
        for _, s, x, y in batches(b):
            init, trans = p.chain(y.shape[1])
            pz = prior(p, y)
            post = concept_posterior_steps(init, trans, pz, emitted(p, s, x)[0], s)
            yield classifier_gradient(p.concept_kind, p.concept, y, np.moveaxis(post - pz, -1, 0), p.width)

    return {n: v.reshape(p.concept[n].shape) for n, v in add_up(pairs, stats).items()}
