"""Sparse bigram emissions against a dense version; blocks; checkpoints removed."""

import gc
import glob
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import bigrams as B
from threadloom.operators import hmm
from threadloom.operators import retrieval as R
from threadloom.sources.shared import keep, shared_dir


def pairs(seed):
    r = random.Random(seed)
    src, trg = [], []
    for p in range(12):
        src += [(p, t, r.choice("abcd")) for t in range(r.randint(1, 5))]
        trg += [(p, j, c) for j, c in enumerate(r.sample("XYZ", r.randint(1, 3)))]
    return src, trg


def dense(src, trg, chain, rounds):
    """By whole matrices concept x previous x token, with known concepts."""
    at = lambda rows, p: [x for q, _, x in sorted(rows) if q == p]
    words, kinds = ["", *"abcd"], list("XYZ")
    data = [([words.index(w) for w in at(src, p)], [kinds.index(c) for c in at(trg, p)]) for p in sorted({p for p, _, _ in src})]
    n = np.zeros((3, 5, 5))
    for x, y in data:
        for a, b in zip([0, *x], x):
            n[y, a, b] += 1
    for k in range(rounds + 1):
        obs = np.divide(n, n.sum(-1, keepdims=True), out=np.zeros_like(n), where=n.sum(-1, keepdims=True) > 0)
        if k == rounds:
            return {(kinds[i], words[a], words[b]): obs[i, a, b] for i, a, b in zip(*np.nonzero(obs))}
        n = np.zeros_like(n)
        for x, y in data:
            init, trans = chain[len(y)]
            prev = [0, *x[:-1]]
            e = np.array([[obs[z, a, b] for z in y] for a, b in zip(prev, x)])
            alpha, c = hmm.forward(init, trans, np.eye(len(y))[None], e[None])
            g = (alpha * hmm.backward(trans, np.eye(len(y))[None], e[None], c)).sum(-1)[0]
            for t, (a, b) in enumerate(zip(prev, x)):
                np.add.at(n, (y, a, b), g[t])


@pytest.mark.parametrize("seed", [0, 1])
def test_sparse_equals_dense(spark, seed):
    src, trg = pairs(seed)
    chain = {m: (np.full(m, 1 / m), np.full((m, m), 1 / m) * 0.5 + np.eye(m) * 0.5) for m in (1, 2, 3)}
    co = keep(B.bigram_cooccurrences(spark.createDataFrame(src, "pair_index long, pos long, token string"), spark.createDataFrame(trg, "pair_index long, pos long, concept string")))
    got = {(r["concept"], r["prev"], r["token"]): r["p"] for r in B.train(co, chain, 2, size=2).collect()}
    want = dense(src, trg, chain, 2)
    assert set(want) <= set(got)
    assert all(abs(got[k] - want.get(k, 0)) < 1e-9 for k in got)


def test_untrained_bigrams_nulls_and_empty(spark):
    src = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, "q")], "pair_index long, pos long, token string")
    trg = spark.createDataFrame([(1, 0, "X"), (2, 0, None)], "pair_index long, pos long, concept string")
    co = B.bigram_cooccurrences(src, trg)
    assert sorted((r["prev"], r["token"], r["concept"]) for r in co.collect()) == [("", "a", "X"), ("", "q", ""), ("a", "", "X")]
    cells = B.shares(co.where("pair_index = 1").withColumn("n", F.lit(1.0)))
    e = {(r["pair_index"], r["pos"]): r["e"] for r in B.emissions(co, cells, 1e-3).collect()}
    assert e == {(1, 0): [1.0], (1, 1): [1.0], (2, 0): [1e-3]}
    assert B.train(keep(co.limit(0)), {}, 1).collect() == []


@pytest.mark.parametrize("most", [(1000, 1000), (7, 11)])
def test_blocks_meet_once(spark, most):
    left, right = spark.range(50).withColumnRenamed("id", "l"), spark.range(60).withColumnRenamed("id", "r")
    a, b = R.in_blocks(left, right, *most, least=3)
    met = a.join(b, ["_lb", "_rb"]).select("l", "r")
    assert met.count() == 3000 == met.distinct().count()
    assert R.in_blocks(left.limit(0), right, *most)[0].count() == 0


def test_true_ranks_by_sorting(spark):
    r = random.Random(3)
    q = [(i, r.randrange(3), r.random()) for i in range(6)]
    it = [(i, r.randrange(3), round(r.random(), 1)) for i in range(40)]
    score = F.round(F.abs(F.col("u") - F.col("v")), 1)
    got = R.true_ranks(spark.createDataFrame(q, "query_id long, ql long, u double"), spark.createDataFrame(it, "item_id long, il long, v double"), score, F.col("ql") == F.col("il"), F.col("query_id") != F.col("item_id"))
    want = {}
    for i, ql, u in q:
        rows = sorted(((float(f"{abs(u - v):.1f}"), j, il) for j, il, v in it if j != i), reverse=True)
        want[i] = 1 + min(k for k, x in enumerate(rows) if x[2] == ql)
    assert {x["query_id"]: x["rank"] for x in got.collect()} == want


def test_kept_tables_are_removed(spark):
    shared_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{folder}/rdd-*"))
    df = keep(spark.range(10))
    new = set(glob.glob(f"{folder}/rdd-*")) - before
    assert df.count() == 10 and new
    del df
    for _ in range(40):
        gc.collect()
        spark._jvm.System.gc()
        if not new & set(glob.glob(f"{folder}/rdd-*")):
            break
        time.sleep(0.25)
    assert not new & set(glob.glob(f"{folder}/rdd-*"))
