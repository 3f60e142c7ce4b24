"""Variational model in long format, cepstra as expressions, clamped posteriors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import audio
from threadloom.operators import cepstra, corrlda, hmm, variational

SRC = "pair_index long, spos long, token long"
REG = "pair_index long, tpos long, vec array<double>"


def tables(spark, pairs):
    src = [(i, t, x) for i, (xs, _) in enumerate(pairs) for t, x in enumerate(xs)]
    reg = [(i, t, v) for i, (_, ys) in enumerate(pairs) for t, v in enumerate(ys)]
    return spark.createDataFrame(src, SRC), spark.createDataFrame(reg, REG)


def test_rounds_equal_kernel(spark):
    r = np.random.default_rng(5)
    pairs = [(r.integers(0, 4, r.integers(1, 5)).tolist(), r.normal(0, 1, (r.integers(1, 4), 2)).round(3).tolist()) for _ in range(12)]
    pairs += [([0, 1, 2, 3], [[0.0, 0.0]])] + [pairs[0]] * 3  # every token; repeated pairs
    means = [[1.0, 0.0], [-1.0, 0.5], [0.0, -1.0]]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "pair_index long, x array<int>, y array<array<double>>")
    m = corrlda.start(sorted({len(y) for _, y in pairs}), 3, np.array(means)[:, None], 0.5, v=4, chain=False, alpha=1.5, kappa=0.7)
    m, post, _ = corrlda.train(rows, m, 3)
    got, q, p = variational.rounds(*tables(spark, pairs), means, 0.5, 3, alpha=1.5, kappa=0.7)
    sticks = p.sticks.first()
    assert np.array([sticks.now, sticks.later]).T == pytest.approx(m.sticks)
    assert {(s.n, s.tpos): s.c for s in p.starts.collect()} == pytest.approx({(n, i): c for n, v in m.starts.items() for i, c in enumerate(v)})
    assert np.array([t.p for t in p.tokens.orderBy("token").collect()]).T == pytest.approx(m.tokens)
    assert np.array(p.means.first().means) == pytest.approx(m.mean_v[:, 0])
    want = {(s.pair_index, t, i): a for s in post.collect() for t in range(len(s.x)) for i, a in enumerate(s.align[t * len(s.y) : (t + 1) * len(s.y)])}
    assert {(s.pair_index, s.spos, s.tpos): s.a for s in got.collect()} == pytest.approx(want)
    zs = {s.pair_index: np.array(s.z).reshape(-1, 3) for s in post.collect()}
    assert all(s.q == pytest.approx(zs[s.pair_index][s.tpos].tolist()) for s in q.collect())


def test_rounds_of_nothing(spark):
    src, reg = tables(spark, [([], [[1.0, 0.0]]), ([1], [])])
    post, q, p = variational.rounds(src, reg, [[1.0, 0.0], [0.0, 1.0]], 0.5, 2)
    assert post.count() == q.count() == 0
    assert p.means.first().means == [[1.0, 0.0], [0.0, 1.0]]
    assert p.sticks.first().now == [1.0, 1.0]


@pytest.mark.parametrize(("n", "s"), [(2000, cepstra.Settings(rate=4000, window=100, hop=40, n_mels=10, n_cepstra=5)), (50, cepstra.Settings(rate=4000, window=100, hop=40, n_mels=10, n_cepstra=5, orders=1)), (333, cepstra.Settings(rate=8000, window=64, hop=64, n_mels=8, n_cepstra=4, orders=0, preemphasis=0.5))])
def test_cepstra_equal_kernel(spark, n, s):
    x = np.random.default_rng(n).normal(0, 1, n)
    got = cepstra.cepstra(spark.createDataFrame([(x.tolist(),)], "signal array<double>"), "signal", s).first().frames
    want = audio.mfcc(x, s.rate, s.n_cepstra, s.n_mels, 1000 * s.window / s.rate, 1000 * s.hop / s.rate, s.preemphasis, s.orders)
    assert np.array(got) == pytest.approx(want, abs=1e-8)


def test_cepstra_edges(spark):
    s = cepstra.Settings(rate=800, window=16, hop=8, n_mels=4, n_cepstra=3)
    rows = spark.createDataFrame([(0, None), (1, []), (2, [None, 1.0] * 20), (3, [0.0, 1.0] * 20), (4, [0.0] * 20)], "id int, signal array<double>")
    got = {r.id: r.frames for r in cepstra.cepstra(rows, "signal", s).collect()}
    assert got[0] == got[1] == []
    assert got[2] == got[3]
    assert got[4][0] == pytest.approx([2 * np.log(1e-10), 0, 0] + [0] * 6, abs=1e-9)
    assert cepstra.cepstra(rows.where("id > 9"), "signal", s).count() == 0
    plan = cepstra.cepstra(rows.select(F.col("signal")), "signal", s)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


@pytest.mark.parametrize("kind", ["linear", "rbf", "mlp"])
def test_concept_gradient_is_numeric(spark, kind):
    """The gradient at the weights is that of the log-likelihood of the mixed chain."""
    r = np.random.default_rng(1)
    p = hmm.start([1], 3, 4, 2, kind, hidden=4, seed=2)
    rows = [(i, r.integers(0, 4, 3).tolist(), r.normal(0, 1, (1, 2)).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "pair_index long, x array<int>, y array<array<double>>")
    got = hmm.concept_gradient(df, p)

    def ll(w):
        total = 0.0
        for _, x, y in rows:  # one target: its concept emits every position
            pz = hmm.classify(kind, w, np.array(y), p.width)[0]
            total += np.log((pz * np.prod(p.obs[:, x], 1)).sum())
        return total

    for name, g in got.items():
        for at in [(0, 0), (1, 1), (2, 0)]:
            up = {n: v.copy() for n, v in p.concept.items()}
            up[name][at] += 1e-6
            down = {n: v.copy() for n, v in p.concept.items()}
            down[name][at] -= 1e-6
            assert g[at] == pytest.approx((ll(up) - ll(down)) / 2e-6, abs=1e-5)


def test_concept_posteriors_rows(spark):
    p = hmm.start([1, 2], 3, 4, 2, seed=3)
    df = spark.createDataFrame([(7, [0, 1], [[1.0, 0.0], [0.0, 1.0]]), (8, [], [[1.0, 0.0]]), (9, [2], [[0.0, 1.0]])], "pair_index long, x array<int>, y array<array<double>>")
    got = hmm.concept_posteriors(df, p).groupBy("pair_index", "state").agg(F.sum("post").alias("s"), F.sum("prior").alias("t")).collect()
    assert {(r.pair_index, r.state) for r in got} == {(7, 0), (7, 1), (9, 0)}
    assert all(r.s == pytest.approx(1) and r.t == pytest.approx(1) for r in got)
