"""Column expressions of the numeric and string primitives."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def round_binary(x: Column, digits: int) -> Column:
    """``x`` times 10^digits in binary, rounded, halves away from zero, and divided
    again: as C and DuckDB round. Spark's ``round`` takes the shortest decimal of
    ``x`` instead, which differs next to a half (8.0496445) and beyond 2^53 units."""
    unit = 10.0**digits
    size = F.abs(x * unit)
    near = F.rint(size)
    whole = F.when(size - near == 0.5, near + 1).otherwise(near)  # rint gives the even one
    return F.when(size == float("inf"), x).otherwise(F.signum(x) * whole / unit)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(u: Column, v: Column) -> Column:
    return total(F.zip_with(u, v, lambda x, y: x * y))


def squared_distance(u: Column, v: Column) -> Column:
    return total(F.zip_with(u, v, lambda x, y: (x - y) * (x - y)))


def l2_normalise(v: Column) -> Column:
    """P03; a zero vector stays as it is."""
    return let(F.sqrt(dot(v, v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def logsumexp(v: Column) -> Column:
    """P23, shifted by the maximum; an empty array gives null."""
    return let(F.array_max(v), lambda m: m + F.log(total(F.transform(v, lambda x: F.exp(x - m)))))


def log_dot(u: Column, v: Column) -> Column:
    """Log of the dot product of two vectors of logs."""
    return let(F.zip_with(u, v, lambda x, y: x + y), logsumexp)


def gaussian_log(x: Column, mean: Column, var: Column) -> Column:
    """P25: log density of a diagonal Gaussian."""
    terms = F.zip_with(F.zip_with(x, mean, lambda a, b: (a - b) * (a - b)), var, lambda d, s: -0.5 * (F.log(s * 2 * math.pi) + d / s))
    return total(terms)


def gaussian(x: Column, mean: Column, var: Column) -> Column:
    return F.exp(gaussian_log(x, mean, var))


def kl_categorical(p_log: Column, q_log: Column) -> Column:
    """P27 of two log-probability vectors."""
    return total(F.zip_with(p_log, q_log, lambda a, b: F.exp(a) * (a - b)))


def kl_gaussian(m0: Column, v0: Column, m1: Column, v1: Column) -> Column:
    """P27 of two diagonal Gaussians."""
    a = total(F.zip_with(v0, v1, lambda x, y: x / y - 1 - F.log(x / y)))
    b = total(F.zip_with(F.zip_with(m0, m1, lambda x, y: (x - y) * (x - y)), v1, lambda d, s: d / s))
    return (a + b) * 0.5


def stick_breaking(v: Column) -> Column:
    """v_k times the product of 1 - v_j over j < k."""
    start = F.struct(F.lit(1.0).alias("left"), F.array().cast("array<double>").alias("out"))
    step = lambda a, x: F.struct((a["left"] * (1 - x)).alias("left"), F.concat(a["out"], F.array(a["left"] * x)).alias("out"))
    return F.aggregate(v, start, step, lambda a: a["out"])


def softmax(z: Column) -> Column:
    """Of a vector of scores."""
    return let(logsumexp(z), lambda n: F.transform(z, lambda x: F.exp(x - n)))


def linear(v: Column, weights: Sequence[Sequence[float]]) -> Column:
    """W [v; 1], one score for each row of W."""
    return F.array(*[dot(v, F.array(*[F.lit(float(w)) for w in row[:-1]])) + float(row[-1]) for row in weights])


def rbf(v: Column, centres: Sequence[Sequence[float]], width: float) -> Column:
    """-|v - c|^2 / width for each centre."""
    return F.array(*[-squared_distance(v, F.array(*[F.lit(float(w)) for w in c])) / float(width) for c in centres])


def relu(z: Column) -> Column:
    return F.transform(z, lambda x: F.greatest(x, F.lit(0.0)))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two half-open intervals; 0 if they don't meet."""
    inter = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(inter <= 0, F.lit(0.0)).otherwise(inter.cast("double") / (F.greatest(e1, e2) - F.least(s1, s2)))


def pad(v: Column, n: int, centred: bool = False, zero: object = 0.0) -> Column:
    """Cut or zero-pad to ``n`` items, at the right or around the centre."""
    gap = F.greatest(F.lit(n) - F.size(v), F.lit(0))
    left = F.floor(gap / 2).cast("int") if centred else F.lit(0)
    return F.slice(F.concat(F.array_repeat(F.lit(zero), left), v, F.array_repeat(F.lit(zero), gap - left)), 1, n)


def block_mean(v: Column, n: int) -> Column:
    """N block means of a signal, the remainder left out (length >= n)."""
    step = F.floor(F.size(v) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: total(F.slice(v, i * step + 1, step)) / step)


def interpolate(v: Column, n: int) -> Column:
    """N points of the piecewise linear curve through a signal, ends included."""

    def at(i: Column) -> Column:
        x = i * (F.size(v) - 1) / F.lit(float(max(n - 1, 1)))
        lo = F.floor(x).cast("int")
        a, b = F.get(v, lo), F.coalesce(F.get(v, lo + 1), F.get(v, lo))
        return a + (b - a) * (x - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def merge_repeats(v: Column) -> Column:
    """Equal neighbours become one."""
    return F.filter(v, lambda x, i: (i == 0) | (x != F.get(v, i - 1)))


def ctc_greedy(frames: Column, blank: int = 0) -> Column:
    """Best class of each frame (first on ties), repeats merged, blanks dropped."""
    best = F.transform(frames, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))
    return let(best, lambda p: F.filter(merge_repeats(p), lambda x: x != blank))


def edit_counts(ref: Column, hyp: Column) -> Column:
    """struct<dist, ins, del, sub, corr> of the best alignment of two token
    arrays. A reference token without partner counts as ``ins``, a hypothesis
    token without partner as ``del``; on ties a match or substitution is
    preferred, then ``ins``."""
    cell = "struct<dist:int,ins:int,del:int,sub:int,corr:int>"

    def make(d, i, e, s, c) -> Column:
        return F.struct(d.cast("int").alias("dist"), i.cast("int").alias("ins"), e.cast("int").alias("del"), s.cast("int").alias("sub"), c.cast("int").alias("corr"))

    zero = F.lit(0)
    first = F.transform(F.sequence(zero, F.size(hyp)), lambda j: make(j, zero, j, zero, zero))

    def row(prev: Column, r: Column) -> Column:
        up = F.get(prev, 0)
        start = F.array(make(up["dist"] + 1, up["ins"] + 1, up["del"], up["sub"], up["corr"]))

        def extend(acc: Column, h: Column) -> Column:
            j = F.size(acc)
            diag, above, left = F.get(prev, j - 1), F.get(prev, j), F.element_at(acc, -1)
            same = (h == r).cast("int")
            d, u, e = diag["dist"] + 1 - same, above["dist"] + 1, left["dist"] + 1
            best = F.when((d <= u) & (d <= e), make(d, diag["ins"], diag["del"], diag["sub"] + 1 - same, diag["corr"] + same)).when(u <= e, make(u, above["ins"] + 1, above["del"], above["sub"], above["corr"])).otherwise(make(e, left["ins"], left["del"] + 1, left["sub"], left["corr"]))
            return F.concat(acc, F.array(best))

        return F.aggregate(hyp, start.cast(f"array<{cell}>"), extend)

    return F.element_at(F.aggregate(ref, first.cast(f"array<{cell}>"), row), -1)


def viterbi(obs: Column, init: Sequence[float], trans: Sequence[Sequence[float]], emit: Sequence[Sequence[float]]) -> Column:
    """K09 for few states: best path over token ids, with plain array functions
    in log space. Ties go to the lower state."""
    n = len(init)
    log = lambda p: F.lit(math.log(p) if p > 0 else -1e300)
    emission = lambda x: [F.get(F.array(*[log(p) for p in emit[s]]), x) for s in range(n)]
    cell = lambda score, path: F.struct(score.alias("score"), path.alias("path"))

    def step(acc: Column, x: Column) -> Column:
        e = emission(x)
        out = []
        for j in range(n):
            best = None
            for i in range(n):
                prev = F.get(acc, i)
                score = prev["score"] + log(trans[i][j])
                best = (score, prev["path"]) if best is None else (F.when(score > best[0], score).otherwise(best[0]), F.when(score > best[0], prev["path"]).otherwise(best[1]))
            out.append(cell(best[0] + e[j], F.concat(best[1], F.array(F.lit(j)))))
        return F.array(*out)

    first = F.get(obs, 0)
    e = emission(first)
    start = F.array(*[cell(log(init[s]) + e[s], F.array(F.lit(s))) for s in range(n)])

    def pick(acc: Column) -> Column:
        best = F.get(acc, 0)
        for s in range(1, n):
            other = F.get(acc, s)
            best = F.when(other["score"] > best["score"], other).otherwise(best)
        return best["path"]

    return F.aggregate(F.slice(obs, 2, F.greatest(F.size(obs) - 1, F.lit(0))), start, step, pick)


def digamma(x: Column) -> Column:
    """The recurrence, 6 steps up, then the asymptotic series; ``x`` above 0."""
    up = F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.lit(0.0), lambda s, k: s - 1 / (x + k))
    z = x + 6
    y = 1 / (z * z)
    return up + F.log(z) - 0.5 / z - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def crop_image(image: Column, width: int, box: tuple[Column, Column, Column, Column], out: int) -> Column:
    """The box (x, y, w, h) of a grey image (row by row, ``width`` wide),
    scaled to ``out`` x ``out`` by the nearest pixel; what lies outside is 0."""
    x, y, w, h = box
    height = F.floor(F.size(image) / width)

    def pixel(i: Column) -> Column:
        col = x + F.floor((F.pmod(i, F.lit(out)) + 0.5) * w / out)
        row = y + F.floor((F.floor(i / out) + 0.5) * h / out)
        inside = (col >= 0) & (col < width) & (row >= 0) & (row < height)
        return F.when(inside, F.get(image, (row * width + col).cast("int"))).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(out * out - 1)), pixel)


def grey_to_rgb(image: Column) -> Column:
    """Each value three times, one after the other."""
    return F.flatten(F.transform(image, lambda v: F.array_repeat(v, 3)))


def standardised(image: Column, mean: float, deviation: float) -> Column:
    """Values less a fixed mean, over a fixed deviation."""
    return F.transform(image, lambda v: (v - mean) / deviation)
