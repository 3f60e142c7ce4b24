"""The segmentation sampler: lattice against enumeration, sweeps, repeats."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import wordseg as W

RNG = np.random.default_rng(11)


def ways(last, shortest, longest):
    """All cuts of marks 0..last into segments of allowed lengths."""
    for r in range(last):
        for inner in itertools.combinations(range(1, last), r):
            cuts = (0, *inner, last)
            spans = list(zip(cuts, cuts[1:]))
            if all(shortest <= j - i <= longest for i, j in spans):
                yield spans


def five(shortest=1, longest=6, frames=5):
    x = RNG.normal(0, 0.3, (frames, 4))
    lattice = W.Lattice(x, list(range(frames + 1)), 2, "interpolate", shortest, longest)
    n = np.array([3.0, 0.0, 5.0])
    return lattice, W.Components(n, n[:, None] * RNG.normal(0, 0.3, (3, 8)), 0.2)


@pytest.mark.parametrize("shortest,longest", [(1, 6), (1, 2), (2, 3), (2, 6)])
def test_filter_sums_all_ways(shortest, longest):
    lattice, model = five(shortest, longest)
    scores = lattice.scores(model)
    listed = [(w, sum(scores[lattice.at[s]] for s in w)) for w in ways(5, shortest, longest)]
    total = np.logaddexp.reduce([v for _, v in listed])
    assert lattice.forward(scores)[-1] == pytest.approx(total)
    share = {tuple(w): np.exp(v - total) for w, v in listed}
    cut = [sum(p for w, p in share.items() if any(j == m for _, j in w) or m == 0) for m in range(6)]
    assert lattice.cut_posteriors(scores) == pytest.approx(cut)
    assert lattice.best(scores) == list(max(share, key=share.get))


def test_samples_follow_the_posterior():
    lattice, model = five(1, 3)
    scores = lattice.scores(model) / 2
    listed = {tuple(w): sum(scores[lattice.at[s]] for s in w) for w in ways(5, 1, 3)}
    total = np.logaddexp.reduce(list(listed.values()))
    rng, n = np.random.default_rng(2), 4000
    seen = {}
    for _ in range(n):
        w = tuple(lattice.sample(scores, rng.random))
        seen[w] = seen.get(w, 0) + 1
    assert set(seen) <= set(listed)
    for w, v in listed.items():
        p = np.exp(v - total)
        assert abs(seen.get(w, 0) / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_marginal_is_the_predictive_mixture():
    _, model = five()
    e = RNG.normal(0, 0.3, 8)
    share = (model.n + model.alpha / 3) / (model.n.sum() + model.alpha)
    total = 0.0
    for k in range(3):
        post = 1 / (1 / model.prior_var + model.n[k] / model.var)
        mean, var = post / model.var * model.s[k], post + model.var
        total += share[k] * np.prod(np.exp(-0.5 * (e - mean) ** 2 / var) / np.sqrt(2 * np.pi * var))
    assert model.log_marginal(e[None])[0] == pytest.approx(np.log(total))


def test_step_keeps_counts_whole():
    """A pair's segments leave the counts and its new ones enter them."""
    settings = W.Settings(3, 2, 0.2, technique="interpolate", longest=3)
    lattice, _ = five(1, 3)
    rng = np.random.default_rng(4)
    spans, kinds = settings.first(lattice, rng)
    assert spans[0][0] == 0 and spans[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    other = RNG.normal(0, 0.3, (3, 8))
    model = W.Components(np.ones(3), other.copy(), 0.2)
    for s, k in zip(spans, kinds):
        model.move(k, lattice.vectors[lattice.at[s]], 1.0)
    for heat in (1.5, 1.0, None):
        spans, kinds = settings.resample(lattice, spans, kinds, model, rng, heat)
    n, s = np.ones(3), other.copy()
    for span, k in zip(spans, kinds):
        n[k] += 1
        s[k] += lattice.vectors[lattice.at[span]]
    assert model.n == pytest.approx(n) and model.s == pytest.approx(s)


def test_no_way_through():
    """Where no segments of the allowed lengths fit, the whole is one."""
    lattice = W.Lattice(np.ones((5, 2)), [0, 5], 2, "interpolate", shortest=2, longest=3)
    assert lattice.spans == [(0, 1)]


@pytest.fixture(scope="module")
def pairs(spark):
    """Two kinds of sound in runs of three frames."""
    rng = np.random.default_rng(6)
    rows = []
    for p in range(40):
        kinds = rng.integers(0, 2, 3)
        x = np.repeat(np.array([[0.0, 1.0], [1.0, 0.0]])[kinds], 3, 0) + rng.normal(0, 0.02, (9, 2))
        rows.append((p, x.tolist(), list(range(10))))
    rows += [(100, [], [0]), (101, [[0.0, 1.0]], [0, 1])]
    return spark.createDataFrame(rows, "pair_index long, x array<array<double>>, marks array<int>")


def run(pairs, **kw):
    out = W.sample_segments(pairs, 4, 2, 0.01, 4, hottest=2.0, technique="interpolate", longest=4, seed=5, **kw)
    return sorted(map(tuple, out.collect()))


def test_sweeps(pairs):
    got = run(pairs, per_part=15)
    assert got == run(pairs, per_part=15)
    by = {}
    for p, seg, start, end, _ in got:
        by.setdefault(p, []).append((seg, start, end))
    assert set(by) == {*range(40), 101}
    for p, spans in by.items():
        assert [s[0] for s in spans] == list(range(len(spans)))
        assert spans[0][1] == 0 and spans[-1][2] == (9 if p < 100 else 1)
        assert all(a[2] == b[1] for a, b in zip(spans, spans[1:]))


def test_segments_are_pure(pairs):
    """Hardly a segment spans both kinds of sound, over several partitions too."""
    x = {r.pair_index: np.array(r.x) for r in pairs.where(F.col("pair_index") < 100).collect()}
    for per_part in (15, 2048):
        mixed = [1 for p, _, a, b, _ in run(pairs, per_part=per_part) if p < 100 and np.ptp(x[p][a:b].argmax(1))]
        assert len(mixed) <= 4


def test_empty(spark, pairs):
    assert W.sample_segments(pairs.where("false"), 2, 2, 0.1, 1).count() == 0
