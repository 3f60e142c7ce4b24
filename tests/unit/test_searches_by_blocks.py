"""Searches inside blocks against plain loops: copies, ties, labels, own ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import retrieval as R


def vectors(n):
    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(4)] for _ in range(n // 3)]
    return [(i, base[r.randrange(len(base))], r.randrange(4)) for i in range(n)]  # many copies: many ties


def sides(spark, rows, every=7):
    df = spark.createDataFrame(rows, "id long, v array<double>, l long")
    return df.where(f"id % {every} = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("l").alias("ql")), df.select(F.col("id").alias("item_id"), F.col("v").alias("iv"), F.col("l").alias("il"))


@pytest.mark.parametrize("tile", [1 << 22, 64])
def test_cosines_as_by_expressions(spark, monkeypatch, tile):
    monkeypatch.setattr(R._Cosines, "TILE", tile)
    q, i = sides(spark, vectors(120))
    score = F.round(R.cosine(F.col("qv"), F.col("iv")), 6)
    every = R.score_all(q, i, score).where("query_id <> item_id").select("query_id", "item_id", "score")
    key = lambda r: (r["query_id"], r["rank"], r["item_id"], r["score"])
    assert sorted(map(key, R.cosine_best(q, i, 5).collect())) == sorted(map(key, R.n_best(every, 5).collect()))
    want = R.true_ranks(q, i, score, F.col("ql") == F.col("il"), F.col("query_id") != F.col("item_id"))
    assert sorted(map(tuple, R.cosine_ranks(q, i).collect())) == sorted(map(tuple, want.select("query_id", "rank").collect()))


def test_half_up(spark):
    x = [0.5, -0.0000005, 0.0000005, 0.1234565, -0.1234565, 0.1234564999, 1 / 3, 0.0, 1.0]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert R.half_up(np.array(x), 6).tolist() == want


def test_jaccard_by_loops(spark):
    r = random.Random(2)
    docs = [(i, r.choice(["a", "b", None]), sorted({f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(r.randrange(0, 40))})) for i in range(150)] + [(500, "a", None), (501, "a", [])]
    df = spark.createDataFrame(docs, "id long, lang string, t array<string>")
    left = df.where("id % 5 = 0").select("lang", F.col("id").alias("l_id"), F.col("t").alias("l_tokens"))
    got = {x.l_id: (x.r_id, x.sim) for x in R.jaccard_best(left, df.select("lang", F.col("id").alias("r_id"), F.col("t").alias("r_tokens")), "lang").collect()}
    want = {}
    for i, lang, t in docs:
        of = [(round(len(set(t) & set(u)) / len(set(t) | set(u)), 9), -j) for j, other, u in docs if i % 5 == 0 and t and u and j != i and other == lang is not None]
        if of and max(of)[0] > 0:
            want[i] = (-max(of)[1], max(of)[0])
    assert got == want


def test_overlaps_dense_and_rare():
    import pyarrow as pa

    r = random.Random(1)
    l, x = ([[f"t{k}" for k in {int(r.expovariate(0.02)) for _ in range(12)}] for _ in range(n)] for n in (40, 70))
    la, xa = pa.array(l, pa.list_(pa.string())), pa.array(x, pa.list_(pa.string()))
    got = np.concatenate([b for _, b in R._overlaps(la, xa, pa.array(sorted({t for s in l for t in s})), chunk=16, width=8)])
    assert got.tolist() == [[len(set(a) & set(b)) for a in l] for b in x]
