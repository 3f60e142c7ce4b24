"""Oversampled k-means seeds, and alignment search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import em, hmm, retrieval
from threadloom.plans import models


@pytest.fixture(scope="module")
def clusters(spark):
    """Three clusters of frames per concept; the first frames all lie in one."""
    rng = np.random.default_rng(3)
    frames, trg = [], []
    for p in range(120):
        c = p % 2
        trg.append((p, 0, f"c{c}"))
        for t in range(3):
            centre = np.array([10.0 * c, 0.0]) + (0 if p < 20 else [[0, 0], [0, 6], [6, 0]][rng.integers(3)])
            frames.append((p, t, (centre + rng.normal(0, 0.1, 2)).tolist()))
    return spark.createDataFrame(frames, "pair_index long, pos long, vec array<double>"), spark.createDataFrame(trg, "pair_index long, pos long, concept string")


def test_seeds(clusters):
    frames, trg = clusters
    seeds = em.kmeans_seeds(frames, trg, 3, factor=4.0)
    rows = sorted((r.concept, r.m, tuple(r["mean"])) for r in seeds.collect())
    assert [r[:2] for r in rows] == [(c, m) for c in ("c0", "c1") for m in range(3)]
    known = {(r.pair_index, tuple(r.vec)) for r in frames.collect()}
    assert {r[2] for r in rows} <= {v for _, v in known}
    for c in ("c0", "c1"):  # one seed in each cluster
        own = np.round((np.array([r[2] for r in rows if r[0] == c]) - [10.0 * (c == "c1"), 0]) / 6)
        assert len({tuple(x) for x in own}) == 3
    again = em.kmeans_seeds(frames.repartition(5), trg.repartition(3), 3, factor=4.0)
    assert rows == sorted((r.concept, r.m, tuple(r["mean"])) for r in again.collect())


def test_seeds_cost_less(spark, sf, clusters):
    """Below the cost of the frames of lowest ids, before and after a round."""
    total = lambda f, t, c: em.kmeans_cost(f, t, c).agg(F.sum("cost")).first()[0]
    frames, trg = clusters
    first, seeds = em.first_vectors(frames, trg, 3), em.kmeans_seeds(frames, trg, 3, factor=4.0)
    assert total(frames, trg, seeds) < 0.1 * total(frames, trg, first)
    assert total(frames, trg, em.kmeans(frames, trg, 3, 1, start=seeds)[0]) < 0.1 * total(frames, trg, em.kmeans(frames, trg, 3, 1)[0])
    frames, trg = models.frames_and_labels(spark, sf)
    assert total(frames, trg, em.kmeans_seeds(frames, trg, 2)) <= total(frames, trg, em.first_vectors(frames, trg, 2))


def test_few_different_frames(spark):
    frames = spark.createDataFrame([(0, t, [1.0]) for t in range(4)] + [(1, 0, [5.0])], "pair_index long, pos long, vec array<double>")
    trg = spark.createDataFrame([(0, 0, "a"), (1, 0, "b"), (2, 0, "none")], "pair_index long, pos long, concept string")
    assert sorted((r.concept, r.m, r["mean"]) for r in em.kmeans_seeds(frames, trg, 3).collect()) == [("a", 0, [1.0]), ("b", 0, [5.0])]


def test_first_vectors_limited_before_the_shuffle(clusters):
    plan = em.first_vectors(*clusters, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# alignment search


def share(w):
    return w / w.sum(-1, keepdims=True)


def brute(queries, items, p, n, floor, digits=6):
    obs = np.log(np.maximum(p.obs, floor))
    out = []
    for q, x in queries:
        scored = []
        for i, y in items:
            init, trans = p.chain(len(y))
            s = np.log(init) + obs[y, x[0]]
            for t in x[1:]:
                s = (s[:, None] + np.log(trans)).max(0) + obs[y, t]
            scored.append((round(float(s.max()), digits), i))
        for rank, (score, i) in enumerate(sorted(scored, reverse=True)[:n], 1):
            out.append((q, i, score, rank))
    return sorted(out)


@pytest.mark.parametrize("sparse", [False, True])
def test_chain_search(spark, sparse):
    rng = np.random.default_rng(9)
    k, v = 30, 40
    obs = share(rng.random((k, v)) ** (30 if sparse else 4))
    obs[obs < 1e-4] = 0.0
    p = hmm.Params({m: share(rng.random(m) + 0.2) for m in (1, 2, 3)}, {m: share(rng.random((m, m)) + 0.2) for m in (1, 2, 3)}, obs)
    items = [(i, rng.integers(0, k, rng.integers(1, 5)).tolist()) for i in range(400)]
    items += [(1000 + i, items[i][1]) for i in range(0, 60)]  # repeated target sets
    queries = [(q, rng.integers(0, v, rng.integers(1, 7)).tolist()) for q in range(25)]
    found, scored = retrieval.chain_search(spark.createDataFrame(queries, "query_id long, x array<int>"), spark.createDataFrame(items, "item_id long, y array<int>"), p, 10, 1e-6, blocks=4)
    got = sorted((r.query_id, r.item_id, r.score, r["rank"]) for r in found.collect())
    assert got == brute(queries, items, p, 10, 1e-6)
    if not sparse:  # the bounds leave most pairs unscored
        assert scored.count() < 0.6 * 25 * len({tuple(y) for _, y in items})


def test_chain_search_bounds(spark):
    """No set scores above its bound."""
    rng = np.random.default_rng(10)
    p = hmm.Params({2: share(rng.random(2))}, {2: share(rng.random((2, 2)))}, share(rng.random((6, 5))))
    q = spark.createDataFrame([(0, [0, 1, 1, 4])], "query_id long, x array<int>")
    s = spark.createDataFrame([(i, rng.integers(0, 6, 2).tolist()) for i in range(20)], "set_id long, y array<int>")
    bounds, base = retrieval.chain_bounds(q, s, p, 1e-9)
    exact = {r.set_id: r.score for r in retrieval.chain_scores(s.withColumns({"query_id": F.lit(0).cast("long"), "x": F.array(*map(F.lit, [0, 1, 1, 4]))}), p).collect()}
    rows = bounds.collect()
    assert len(rows) == 20 and all(exact[r.set_id] <= r.bound + 1e-9 for r in rows)
    assert base.first().base == pytest.approx(4 * np.log(1e-9))
