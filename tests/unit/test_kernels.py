"""Numeric kernels against naive loops and brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import numeric as N
from threadloom.functions import special as X
from threadloom.operators import corrlda, hmm, sampling, segmental


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def arr(v):
    return F.array(*[F.lit(x) for x in v])


@pytest.mark.parametrize(
    ("col", "want"),
    [
        (lambda: N.stick_breaking(arr([0.5, 0.5, 1.0])), [0.5, 0.25, 0.25]),
        (lambda: N.merge_repeats(arr([3, 3, 5, 5, 3])), [3, 5, 3]),
        (lambda: N.iou(F.lit(0), F.lit(2), F.lit(1), F.lit(3)), 1 / 3),
        (lambda: N.iou(F.lit(0), F.lit(2), F.lit(2), F.lit(3)), 0.0),
        (lambda: N.pad(arr([7.0]), 3), [7.0, 0.0, 0.0]),
        (lambda: N.pad(arr([7.0, 8.0]), 5, centred=True), [0.0, 7.0, 8.0, 0.0, 0.0]),
        (lambda: N.viterbi(arr([0, 1, 2, 2, 0]), (0.6, 0.4), ((0.7, 0.3), (0.4, 0.6)), ((0.5, 0.4, 0.1), (0.1, 0.3, 0.6))), [0, 0, 1, 1, 0]),
        (lambda: N.kl_categorical(arr(np.log([0.15, 0.55, 0.3]).tolist()), arr(np.log([0.35, 0.25, 0.4]).tolist())), float(np.sum(np.array([0.15, 0.55, 0.3]) * np.log(np.array([0.15, 0.55, 0.3]) / np.array([0.35, 0.25, 0.4]))))),
        (lambda: N.block_mean(arr([1.0, 3.0, 5.0, 7.0, 9.0]), 2), [2.0, 6.0]),
        (lambda: N.interpolate(arr([0.0, 2.0, 4.0]), 5), [0.0, 1.0, 2.0, 3.0, 4.0]),
        (lambda: N.l2_normalise(arr([3.0, 4.0])), [0.6, 0.8]),
        (lambda: N.l2_normalise(arr([0.0, 0.0])), [0.0, 0.0]),
    ],
)
def test_expressions(spark, col, want):
    assert one(spark, col()) == pytest.approx(want)


def test_edit_counts(spark):
    e = one(spark, N.edit_counts(arr([1, 2, 3]), arr([1, 3])))
    assert (e.dist, e.ins, e["del"], e["sub"], e["corr"]) == (1, 1, 0, 0, 2)
    frames = F.array(*[arr([float(i == k) for i in range(3)]) for k in (0, 1, 1, 0, 1, 2, 2)])
    assert one(spark, N.ctc_greedy(frames)) == [1, 1, 2]


def test_digamma():
    x = np.array([0.1, 0.5, 1.0, 3.3, 50.0])
    assert X.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-9)
    assert X.digamma(x + 1) == pytest.approx(X.digamma(x) + 1 / x, abs=1e-9)


def test_embed():
    t = np.arange(16)
    y = np.stack([np.sin(2 * np.pi * t / 16), np.cos(2 * np.pi * t / 16)], 1)
    half = X.embed(y, 8).reshape(2, 8)
    assert half == pytest.approx(y[::2].T, abs=1e-9)
    assert X.embed(y, 4, "rasanen").shape == (8,)
    assert X.embed(y[:1], 3).tolist() == [0, 0, 0, 1, 1, 1]


def test_full_gaussian():
    cov = np.array([[2.0, 0.0], [0.0, 0.5]])
    x, m = np.array([[1.0, 2.0]]), np.array([0.0, 1.0])
    assert X.log_gaussian_full(x, m, cov) == pytest.approx(X.log_gaussian(x, m, np.array([2.0, 0.5])))


def brute(p, x, y):
    """Sum over all state paths and concept draws, by enumeration."""
    init, trans = p.chain(len(y))
    pz = hmm.classify(p.concept_kind, p.concept, y[None], p.width)[0]
    px = hmm.emissions(p, x[None])[0][0]
    m, k = pz.shape
    total, state = 0.0, np.zeros((len(x), m, k))
    for path in itertools.product(range(m), repeat=len(x)):
        for z in itertools.product(range(k), repeat=len(x)):
            w = init[path[0]] * pz[path[0], z[0]] * px[0, z[0]]
            for t in range(1, len(x)):
                stay = path[t] == path[t - 1]
                w *= trans[path[t - 1], path[t]] * (float(z[t] == z[t - 1]) if stay else pz[path[t], z[t]]) * px[t, z[t]]
            total += w
            for t in range(len(x)):
                state[t, path[t], z[t]] += w
    return total, state / total


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(["linear", "rbf", "mlp"]), st.sampled_from(["unigram", "bigram", "phones"]))
def test_forward_backward(seed, kind, emission):
    r = np.random.default_rng(seed)
    p = hmm.start([2], 2, 3, 2, kind, emission, phones=3, frame_dim=2, seed=seed)
    p.trans[2] = r.dirichlet([1, 1], 2)
    p.init[2] = r.dirichlet([1, 1])
    x = r.normal(size=(4, 2)) if emission == "phones" else r.integers(0, 3, 4)
    y = r.normal(size=(2, 2))
    pz = hmm.classify(kind, p.concept, y[None], 1.0)
    px, _ = hmm.emissions(p, x[None])
    a, c = hmm.forward(p.init[2], p.trans[2], pz, px)
    b = hmm.backward(p.trans[2], pz, px, c)
    total, state = brute(p, x, y)
    assert np.exp(np.log(c).sum()) == pytest.approx(total)
    assert (a * b)[0] == pytest.approx(state, abs=1e-9)
    moves = hmm.transition_counts(p.trans[2], pz, px, a, b, False)
    assert moves.sum() == pytest.approx(3)


def test_concept_posterior_by_enumeration():
    r = np.random.default_rng(3)
    pz, px = r.dirichlet([1, 1, 1], (1, 2)), r.random((1, 3, 3))
    init, trans = r.dirichlet([1, 1]), r.dirichlet([1, 1], 2)
    got = hmm.concept_posterior(init, trans, pz, px)[0]
    for i in range(2):
        w = np.zeros(3)
        for k in range(3):
            q = pz[0].copy()
            q[i] = np.eye(3)[k]
            em = px[0] @ q.T
            a = init * em[0]
            for t in (1, 2):
                a = (a @ trans) * em[t]
            w[k] = pz[0, i, k] * a.sum()
        assert got[i] == pytest.approx(w / w.sum())


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6))
def test_viterbi_is_best(seed):
    r = np.random.default_rng(seed)
    init, trans, em = r.dirichlet([1] * 3), r.dirichlet([1] * 3, 3), r.random((4, 3))
    path = hmm.viterbi(init, trans, em[None])[0]
    score = lambda q: init[q[0]] * em[0, q[0]] * np.prod([trans[q[t - 1], q[t]] * em[t, q[t]] for t in range(1, 4)])
    assert score(path) == pytest.approx(max(score(q) for q in itertools.product(range(3), repeat=4)))


def test_gradients():
    r = np.random.default_rng(1)
    v, t = r.normal(size=(5, 3)), r.dirichlet([1, 1], 5)
    for kind in ("linear", "rbf", "mlp"):
        p = hmm.start([1], 2, 2, 3, kind, hidden=4, seed=2)
        of = lambda w, kind=kind: (t * np.log(hmm.classify(kind, w, v, 1.0))).sum()
        g = hmm.classifier_gradient(kind, p.concept, v, t - hmm.classify(kind, p.concept, v, 1.0), 1.0)
        for name, w in p.concept.items():
            i = (0, 1)
            up, down = w.copy(), w.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert g[name][i] == pytest.approx((of({**p.concept, name: up}) - of({**p.concept, name: down})) / 2e-5, abs=1e-4)


def test_em_increases_likelihood(spark):
    rows = [(i, [(i + j) % 3 for j in range(2)], [[float(k == (i + j) % 3) for k in range(3)] for j in range(2)]) for i in range(3)]
    pairs = spark.createDataFrame(rows, "pair_index long, x array<int>, y array<array<double>>")
    p = hmm.start([2], 3, 3, 3, "table", seed=1)
    p, ll = hmm.train(pairs, p, 6)
    assert all(b >= a - 1e-9 for a, b in zip(ll, ll[1:], strict=False))
    out = hmm.decode(pairs, p).collect()
    assert all(len(r.alignment) == 2 and len(r.concepts) == 2 for r in out)
    q, ll = hmm.train(pairs, hmm.start([2], 3, 3, 3, "linear", seed=1), 12, rate=1.0)
    assert ll[-1] > ll[0]


def test_tie():
    c = np.arange(9.0).reshape(3, 3)
    t = hmm.tie(c)
    assert t[0, 0] == t[1, 1] == c.trace()
    assert t[0, 1] == t[1, 2] == c[0, 1] + c[1, 2]
    assert t[2, 0] == c[2, 0]


def test_corrlda(spark):
    rows = [(i, [(i + j) % 3 for j in range(2)], [[float(k == (i + j) % 3) for k in range(3)] for j in range(2)]) for i in range(3)] * 4
    rows = [(n, x, y) for n, (_, x, y) in enumerate(rows)]
    pairs = spark.createDataFrame(rows, "pair_index long, x array<int>, y array<array<double>>")
    for chain in (False, True):
        m = corrlda.start([2], 3, np.eye(3)[:, None, :] * 0.8, 0.1, v=3, chain=chain, kappa=0.1)
        m, post, ll = corrlda.train(pairs, m, 8)
        assert ll[-1] > ll[0]
        good = [(a, z) for r in corrlda.decode(post, m).collect() for a, z in [(r.alignment, r.concepts)]]
        assert sum(a == [0, 1] for a, _ in good) >= 8
    move = np.log(np.array([[0.5, 0.5], [0.2, 0.8]]))
    p, moves = corrlda.chain_posterior(np.log([0.5, 0.5]), move, np.log(np.array([[[0.9, 0.1], [0.5, 0.5], [0.1, 0.9]]])))
    assert p[0].sum(1) == pytest.approx([1, 1, 1])
    assert moves[0, 0, 1] > moves[0, 1, 0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=15, max_size=15), st.integers(1, 2), st.integers(2, 5))
def test_segmentation_is_best(values, shortest, longest):
    marks = [0, 1, 2, 3, 4, 5]
    table = {(i, j): values[k] for k, (i, j) in enumerate((i, j) for i in range(6) for j in range(i + 1, 6))}
    cut, score = segmental.segment(marks, lambda i, j: table[i, j], shortest, longest)
    best = -np.inf
    for r in range(5):
        for inner in itertools.combinations(range(1, 5), r):
            c = [0, *inner, 5]
            if all(shortest <= b - a <= longest for a, b in zip(c, c[1:], strict=False)):
                best = max(best, sum(table[a, b] for a, b in zip(c, c[1:], strict=False)))
    assert score == pytest.approx(best if np.isfinite(best) else table[0, 5])
    assert cut[0] == 0
    assert cut[-1] == 5


def test_gibbs():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.1, (40, 2)) for c in (-2, 0, 2)])
    g = segmental.GibbsMixture(x, 6, 0.02, prior_var=4.0, seed=1)
    g.fit(15, hottest=3.0, shrink=3)
    assert len({tuple(sorted(set(g.z[i * 40 : i * 40 + 40].tolist()))) for i in range(3)}) == 3
    assert g.n.sum() == len(x)


@pytest.mark.parametrize("per_part", [100, 4096])
def test_gibbs_over_all_rows(spark, per_part):
    """Components that only later ids have are learned, over any partitions."""
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.1, (n, 8)) for c, n in ((0, 550), (-2, 150), (2, 150))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    runs = [{q["id"]: q["component"] for q in segmental.gibbs_mixture(rows, 8, 0.05, 5, hottest=2.0, seed=1, per_part=per_part).collect()} for _ in range(2)]
    assert runs[0] == runs[1]
    assert len(runs[0]) == len(x)
    found = [{runs[0][i] for i in range(*span)} for span in ((0, 550), (550, 700), (700, 850))]
    assert not (found[0] & found[1] or found[0] & found[2] or found[1] & found[2])
    assert segmental.gibbs_mixture(rows.where("false"), 8, 0.05, 1).count() == 0


def test_m26_learns_from_all_vectors(spark, tmp_path):
    """Two groups that occur only after the 500 lowest ids come apart."""
    from threadloom.plans import models

    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.1, (n, 64)) for c, n in ((0, 550), (-2, 150), (2, 150))])
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    z = {q["vec_id"]: q["component"] for q in models.m26_gibbs_mixture(spark, str(tmp_path)).collect()}
    found = [{z[i] for i in range(*span)} for span in ((0, 550), (550, 700), (700, 850))]
    assert not (found[0] & found[1] or found[0] & found[2] or found[1] & found[2])


def test_models_see_whole_vectors(spark, sf):
    """What frames, regions and segments are made of has all 64 values."""
    from threadloom.plans import models

    r = models.vector_pairs(spark, sf).first()
    assert {len(v) for v in r["x"] + r["y"]} == {64}
    pairs, means = models._segment_inputs(spark, sf)
    assert {len(v) for v in pairs.first()["x"]} == {64}
    assert {m.shape for m in means.values()} == {(1, 3 * 64)}
    assert {q["dim"] for q in models.m34_noisy_features(spark, sf).collect()} == {64}


def test_sampling(spark):
    w = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 3.0)], "item string, weight double")
    u = spark.range(4000).select(F.col("id").alias("draw"), sampling.hash_uniform(F.col("id")).alias("u"))
    c = {r["item"]: r["count"] for r in sampling.draw(w, u, "item").groupBy("item").count().collect()}
    assert set(c) == {"a", "c"}
    assert sum(c.values()) == 4000
    assert abs(c["a"] / 4000 - 0.25) < 0.03


def test_mfcc():
    from threadloom.functions import audio

    rate = 16000
    t = np.arange(rate) / rate
    x = np.sin(2 * np.pi * 440 * t) + 0.1 * np.random.default_rng(0).normal(size=rate)
    m = audio.mfcc(x, rate)
    assert m.shape == (98, 39)
    assert np.isfinite(m).all()
    louder = audio.mfcc(2 * x, rate) - m  # loudness moves the first cepstrum only
    assert louder[:, 0] == pytest.approx(np.full(98, np.sqrt(40) * np.log(4)))
    assert np.abs(louder[:, 1:]).max() < 1e-9
    assert audio.deltas(np.arange(10.0)[:, None])[4, 0] == pytest.approx(1.0)
    assert (audio.mel_filters(20, 512, rate).sum(1) > 0).all()
