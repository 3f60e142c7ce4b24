"""Chunked chains against the sequential kernels, whatever the chunk size."""

import numpy as np
import pytest

from threadloom.operators import chains, hmm

RNG = np.random.default_rng(8)


def share(w):
    return w / w.sum(-1, keepdims=True)


CHAIN = {m: (share(RNG.random(m) + 0.1), share(RNG.random((m, m)) + 0.05)) for m in (1, 2, 3, 5)}


@pytest.fixture(scope="module")
def sources():
    """Emissions of sources of all lengths, one long, some steps impossible for a state."""
    out = {}
    for p, (t, m) in enumerate([(1, 2), (2, 3), (3, 1), (7, 5), (8, 2), (9, 3), (60, 3), (20, 5)]):
        e = RNG.random((t, m)) + 0.02
        if m > 1:
            e[RNG.random((t, m)) < 0.1] = 0.0
            e[e.sum(1) == 0] = 0.5
        out[p] = e
    return out


@pytest.fixture(scope="module")
def steps(spark, sources):
    rows = [(p, t, e.tolist()) for p, x in sources.items() for t, e in enumerate(x)]
    return spark.createDataFrame(rows, "pair_index long, pos long, e array<double>").repartition(3)


def sequential(e, init, trans):
    a = init * e[0]
    out, ll = [a], 0.0
    for x in e[1:]:
        a = (a @ trans) * x
        out.append(a)
    b = np.ones(len(init))
    post = []
    for a, x in zip(out[::-1], e[::-1]):
        post.append(a * b / (a * b).sum())
        b = trans @ (x * b)
    return np.array(post[::-1]), np.log(out[-1].sum())


@pytest.mark.parametrize("size", [2, 40])
def test_posteriors(steps, sources, size):
    post, ll = chains.posteriors(steps, CHAIN, size)
    got = {(r.pair_index, r.pos, r.state): r.post for r in post.collect()}
    total = {r.pair_index: r.ll for r in ll.collect()}
    for p, e in sources.items():
        want, w = sequential(e, *CHAIN[e.shape[1]])
        assert total[p] == pytest.approx(w, abs=1e-9)
        assert np.array([[got.pop((p, t, j)) for j in range(e.shape[1])] for t in range(len(e))]) == pytest.approx(want, abs=1e-9)
    assert not got


@pytest.mark.parametrize("size", [1, 7])
def test_best_paths(steps, sources, size):
    got = {(r.pair_index, r.pos): r.state for r in chains.best_paths(steps, CHAIN, size).collect()}
    for p, e in sources.items():
        init, trans = CHAIN[e.shape[1]]
        want = hmm.viterbi(init, trans, e[None])[0].tolist()
        assert [got.pop((p, t)) for t in range(len(e))] == want
    assert not got


def test_ties_and_long_underflow(spark):
    """Equal paths: lower states from the end backward, by chunks as in one; a
    source of thousands of tiny emissions keeps its digits."""
    even = {2: (np.array([0.5, 0.5]), np.full((2, 2), 0.5))}
    rows = [(0, t, [0.25, 0.25]) for t in range(5)] + [(1, t, [1e-200, 1e-200]) for t in range(3000)]
    steps = spark.createDataFrame(rows, "pair_index long, pos long, e array<double>")
    for size in (700,):
        assert {r.state for r in chains.best_paths(steps, even, size).collect()} == {0}
    post, ll = chains.posteriors(steps, even, 700)
    assert {round(r.post, 9) for r in post.collect()} == {0.5}
    assert {r.pair_index: r.ll for r in ll.collect()}[1] == pytest.approx(3000 * np.log(1e-200))


def test_empty(spark, steps):
    assert chains.best_paths(steps.where("false"), CHAIN, 2).count() == 0
    post, ll = chains.posteriors(steps.where("false"), CHAIN, 2)
    assert post.count() == 0 and ll.count() == 0
