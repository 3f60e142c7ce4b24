"""Small neural models trained over distributed sums of gradients.

Every round maps batches of rows to partial sums of gradients, adds them up by
key (``hmm.add_up``) and takes one Adam step on the driver, which only ever sees
numbers as large as the parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hmm import add_up, lists, nested, of_one_shape, picked, softmax, with_one

Weights = dict[str, np.ndarray]
#: What CTC calls blank.
BLANK = 0


def log_add(*xs: np.ndarray) -> np.ndarray:
    top = np.maximum.reduce(xs)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(sum(np.exp(x - safe) for x in xs))


def ctc(logp: np.ndarray, labels: list[int]) -> tuple[float, np.ndarray]:
    """(log-likelihood of a label sequence under log probabilities (T, V),
    its gradient by the scores before the softmax). Labels that don't fit into
    T steps have likelihood 0 and no gradient."""
    t_max, path = len(logp), [BLANK]
    for label in labels:
        path += [label, BLANK]
    path = np.array(path)
    s = len(path)
    skip = np.zeros(s, bool)
    skip[2:] = (path[2:] != BLANK) & (path[2:] != path[:-2])
    a, b = np.full((t_max, s), -np.inf), np.full((t_max, s), -np.inf)
    a[0, :2] = logp[0, path[:2]]
    shifted = lambda v, k: np.concatenate([np.full(k, -np.inf), v[:-k]]) if k < s else np.full(s, -np.inf)
    for t in range(1, t_max):
        a[t] = log_add(a[t - 1], shifted(a[t - 1], 1), np.where(skip, shifted(a[t - 1], 2), -np.inf)) + logp[t, path]
    b[-1, -2:] = 0.0
    for t in range(t_max - 2, -1, -1):
        seen = b[t + 1] + logp[t + 1, path]
        back = lambda v, k: shifted(v[::-1], k)[::-1]
        b[t] = log_add(seen, back(seen, 1), back(np.where(skip, seen, -np.inf), 2))
    total = float(log_add(*(a[-1, -2:])))
    if not np.isfinite(total):
        return total, np.zeros_like(logp)
    post = np.exp(a + b - total)
    grad = -np.exp(logp)
    for k in range(logp.shape[1]):
        grad[:, k] += post[:, path == k].sum(1)
    return total, grad


def tdnn(w: Weights, x: np.ndarray, reach: int = 1) -> tuple[np.ndarray, tuple]:
    """Log probabilities (T, V) of frames (T, D): a ReLU layer over each
    frame with ``reach`` neighbours on both sides (zeros outside), a softmax."""
    padded = np.pad(x, ((reach, reach), (0, 0)))
    wide = with_one(np.concatenate([padded[i : i + len(x)] for i in range(2 * reach + 1)], 1))
    hidden = np.maximum(wide @ w["W1"].T, 0)
    z = with_one(hidden) @ w["W2"].T
    return z - z.max(1, keepdims=True) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)), (wide, hidden)


def tdnn_gradient(w: Weights, x: np.ndarray, labels: list[int]) -> tuple[float, Weights]:
    logp, (wide, hidden) = tdnn(w, x)
    value, g = ctc(logp, labels)
    if not np.isfinite(value):
        return 0.0, {k: np.zeros_like(v) for k, v in w.items()}
    back = (g @ w["W2"][:, :-1]) * (hidden > 0)
    return value, {"W1": back.T @ wide, "W2": g.T @ with_one(hidden)}


def attention(w: Weights, src: list[int], trg: list[int]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(attention of each target position over source positions, log
    probabilities of the target tokens, what the gradient needs). The query is
    the embedding of the target token before (row 0: the beginning)."""
    s, q = w["S"][src], w["Q"][[0, *(t + 1 for t in trg[:-1])]]
    att = softmax(q @ w["A"] @ s.T)
    context = att @ s
    return att, np.log(softmax(with_one(context) @ w["O"].T)), (s, q, context)


def attention_gradient(w: Weights, src: list[int], trg: list[int]) -> tuple[float, Weights]:
    """Log-likelihood of a target sequence and its gradient."""
    att, logp, (s, q, context) = attention(w, src, trg)
    d = -np.exp(logp)
    d[np.arange(len(trg)), trg] += 1
    out = {k: np.zeros_like(v) for k, v in w.items()}
    out["O"] = d.T @ with_one(context)
    dc = d @ w["O"][:, :-1]
    da = dc @ s.T
    de = att * (da - (att * da).sum(1, keepdims=True))
    out["A"] = q.T @ de @ s
    np.add.at(out["S"], src, att.T @ dc + de.T @ q @ w["A"])
    np.add.at(out["Q"], [0, *(t + 1 for t in trg[:-1])], de @ s @ w["A"].T)
    return float(logp[np.arange(len(trg)), trg].sum()), out


def _attentions(w: Weights, b: pa.RecordBatch) -> Iterator[tuple]:
    """``attention`` for all rows of equal shape at once: row numbers, sources,
    targets, tokens before, and embeddings, queries, attentions, contexts."""
    nx, fx, xs = nested(b.column("x"))
    ny, fy, ys = nested(b.column("y"))
    for (t, n), every in of_one_shape(nx, ny):
        if not n:
            continue
        if not t:
            raise ValueError("targets without a source")
        for lo in range(0, len(every), step := max(1, min(4096, (1 << 22) // (t * n + t + n)))):
            rows = every[lo : lo + step]
            src, trg = picked(fx[rows], t, xs), picked(fy[rows], n, ys)
            last = np.concatenate([np.zeros((len(rows), 1), np.int64), trg[:, :-1] + 1], 1)
            s, q = w["S"][src], w["Q"][last]
            att = softmax(np.einsum("bnd,btd->bnt", q @ w["A"], s))
            yield rows, src, trg, last, s, q, att, np.einsum("bnt,btd->bnd", att, s)


def _summed(at: np.ndarray, v: np.ndarray, rows: int) -> np.ndarray:
    """Rows of ``v`` added up by their place."""
    return np.stack([np.bincount(at.ravel(), v[..., d].ravel(), minlength=rows) for d in range(v.shape[-1])], 1)


def attention_sums(w: Weights, b: pa.RecordBatch) -> Iterator[Weights]:
    """Log-likelihoods and gradients (``attention_gradient``) of all rows of a
    batch, added up for each shape. Rows without targets count and add nothing."""
    yield {"n": np.array([float(b.num_rows)]), "value": np.zeros(1)} | {k: np.zeros_like(v) for k, v in w.items()}
    for rows, src, trg, last, s, q, att, context in _attentions(w, b):
        p = softmax(with_one(context) @ w["O"].T)
        flat = np.arange(trg.size), trg.ravel()
        d = -p.reshape(trg.size, -1)
        value = np.log(-d[flat]).sum()
        d[flat] += 1
        dc = (d @ w["O"][:, :-1]).reshape(context.shape)
        da = np.einsum("bnd,btd->bnt", dc, s)
        de = att * (da - (att * da).sum(2, keepdims=True))
        des = np.einsum("bnt,btd->bnd", de, s)
        out = {"O": d.T @ with_one(context).reshape(trg.size, -1), "A": q.reshape(trg.size, -1).T @ des.reshape(trg.size, -1)}
        out["S"] = _summed(src, np.einsum("bnt,bnd->btd", att, dc) + np.einsum("bnt,bnd->btd", de, q @ w["A"]), len(w["S"]))
        out["Q"] = _summed(last, des @ w["A"].T, len(w["Q"]))
        yield {"value": np.array([value]), **out}


def attended(rows: DataFrame, w: Weights) -> DataFrame:
    """``pair_index, out``: for each target the source position it attends to
    most; ties (to 12 digits) to the lower position."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(it):
        for b in it:
            n, first, _ = nested(b.column("y"))
            out = np.empty(n.sum(), np.int64)
            for at, _, trg, _, _, _, att, _ in _attentions(sent.value, b):
                out[first[at][:, None] + np.arange(trg.shape[1])] = np.round(att, 12).argmax(2)
            yield pa.RecordBatch.from_arrays([b.column("pair_index").cast(pa.int64()), lists(n, out, pa.int64())], ["pair_index", "out"])

    return rows.select("pair_index", "x", "y").mapInArrow(run, "pair_index long, out array<long>")


def convolved(w: Weights, image: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log probabilities of classes of an image (H, W): 3 x 3 filters, ReLU,
    2 x 2 maxima, a dense softmax. H and W are even + 2 (no border)."""
    h, k = image.shape[0] - 2, image.shape[1] - 2
    patches = with_one(np.stack([image[i : i + h, j : j + k] for i in range(3) for j in range(3)], -1))
    maps = np.maximum(patches @ w["F"].T, 0)
    cells = maps.reshape(h // 2, 2, k // 2, 2, -1).transpose(0, 2, 4, 1, 3).reshape(h // 2, k // 2, -1, 4)
    first = cells.argmax(-1)
    pooled = np.take_along_axis(cells, first[..., None], -1)[..., 0]
    flat = with_one(pooled.ravel())
    z = w["D"] @ flat
    return z - z.max() - np.log(np.exp(z - z.max()).sum()), (patches, first, pooled, flat)


def convolved_gradient(w: Weights, image: np.ndarray, label: int) -> tuple[float, Weights]:
    logp, (patches, first, pooled, flat) = convolved(w, image)
    d = -np.exp(logp)
    d[label] += 1
    back = (d @ w["D"])[:-1].reshape(pooled.shape) * (pooled > 0)
    g = np.zeros((*first.shape, 4))
    np.put_along_axis(g, first[..., None], back[..., None], -1)
    r, c, f = first.shape
    g = g.reshape(r, c, f, 2, 2).transpose(0, 3, 1, 4, 2).reshape(2 * r, 2 * c, f)
    return float(logp[label]), {"F": np.einsum("ijf,ijp->fp", g, patches), "D": np.outer(d, flat)}


Gradient = Callable[[Weights, dict], tuple[float, Weights]]
#: Of a whole batch: parts with sums, among them ``value`` and ``n``.
Sums = Callable[[Weights, pa.RecordBatch], Iterator[Weights]]


def train_net(rows: DataFrame, w: Weights, gradient: Gradient | None, rounds: int, rate: float = 0.05, batched: Sums | None = None) -> tuple[Weights, list[float]]:
    """Full-batch Adam: ``gradient(weights, row)`` gives a row's log-likelihood
    and gradient, or ``batched`` the sums of many. Returns the weights and the mean
    log-likelihood before each step. All rows count in every round."""
    m, v, history = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, []
    for step in range(1, rounds + 1):
        sent = rows.sparkSession.sparkContext.broadcast(w)

        def sums(b, sent=sent):
            if batched:
                yield from batched(sent.value, b)
                return
            for row in b.to_pylist():
                value, g = gradient(sent.value, row)
                yield {"value": np.array([value]), "n": np.array([1.0]), **g}

        got = add_up(rows, sums)
        if not got:
            break
        history.append(float(got["value"][0] / got["n"][0]))
        for k in w:
            g = got[k].reshape(w[k].shape) / got["n"][0]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
        w = {k: x + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) for k, x in w.items()}
    return w, history


def start_net(seed: int = 0, **shapes: tuple[int, ...]) -> Weights:
    r = np.random.default_rng(seed)
    return {k: r.normal(0, 1 / np.sqrt(s[-1]), s) for k, s in shapes.items()}


def apply_net(rows: DataFrame, w: Weights, of: Callable[[Weights, dict], list[int]], key: str = "pair_index") -> DataFrame:
    """``pair_index, out``: what ``of`` gives for each row, as an array of ints."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(it):
        for b in it:
            out = [of(sent.value, row) for row in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["pair_index", "out"])

    return rows.mapInArrow(run, "pair_index long, out array<long>")


def greedy(logp: np.ndarray) -> list[int]:
    """P34 on one matrix: best symbols, repeats merged, blanks dropped."""
    best = logp.argmax(1)
    return [int(s) for t, s in enumerate(best) if s != BLANK and (t == 0 or s != best[t - 1])]
