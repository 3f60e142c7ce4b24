"""Translation models over patterns of source positions against plain loops."""

from collections import defaultdict

import pytest

from threadloom.operators import em


PAIRS = [("ab", "uv"), ("ab", "uv"), ("ab", "uv"), ("ba", "uv"), ("a", "u"), ("cab", "vuw"), ("cab", "vuw")]


def corpus(spark):
    rows = lambda i: [(n, k, t) for n, p in enumerate(PAIRS) for k, t in enumerate(p[i])]
    return spark.createDataFrame(rows(0), "pair_index long, pos long, token string"), spark.createDataFrame(rows(1), "pair_index long, pos long, concept string")


def plain(rounds, prior):
    p, a = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
    met = {(c, t) for x, y in PAIRS for t in x for c in y}
    p.update({(c, t): 1 / sum(c == d for d, _ in met) for c, t in met})
    for _ in range(rounds):
        cp, ca = defaultdict(float), defaultdict(float)
        for x, y in PAIRS:
            for s, t in enumerate(x):
                w = [p[c, t] * a[len(y), len(x), s, k] for k, c in enumerate(y)]
                for k, c in enumerate(y):
                    cp[c, t] += w[k] / sum(w)
                    ca[len(y), len(x), s, k] += w[k] / sum(w)
        p = {k: v / sum(u for j, u in cp.items() if j[0] == k[0]) for k, v in cp.items()}
        if prior:
            a = {k: v / sum(u for j, u in ca.items() if j[:3] == k[:3]) for k, v in ca.items()}
    return p, a


def test_equal_positions_are_one_pattern(spark):
    src, trg = corpus(spark)
    assert em.patterns(em.positions(src, trg)).count() == 6
    assert em.sized(em.positions(src, trg)).count() == 8
    got = {(r.concept, r.token): r.p for r in em.ibm1(src, trg, 3).collect()}
    assert got == pytest.approx(plain(3, False)[0])
    p, a = em.ibm2(src, trg, 3)
    want = plain(3, True)
    assert {(r.concept, r.token): r.p for r in p.collect()} == pytest.approx(want[0])
    assert {(r.lt, r.lf, r.spos, r.tpos): r.a for r in a.collect()} == pytest.approx(want[1])


def test_patterns_at_all_positions(spark):
    at = em.positions(*corpus(spark))
    pats = em.patterns(at)
    best = em.best_targets(em.pattern_pairs(pats), em.ibm1_patterns(pats, 2)).select("pair_index", "alignment")
    got = em.at_patterns(at, pats, best).collect()
    assert len(got) == at.count()
    assert len({(r.token, *r.targets, r.alignment) for r in got}) == 6


def test_small_patterns_go_to_the_positions(spark, monkeypatch):
    at = em.positions(*corpus(spark))
    pats = em.patterns(at)
    best = em.best_targets(em.pattern_pairs(pats), em.ibm1_patterns(pats, 2)).select("pair_index", "alignment")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda: em.at_patterns(at, pats, best)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [token" in plan()
        monkeypatch.setattr(em, "CELLS", 3)
        assert "BroadcastHashJoin" not in plan()
        assert em.at_patterns(at, pats, best).count() == at.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
