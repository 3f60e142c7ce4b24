"""Numbers of lines and blocks over any splits; scores of discovered classes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import metrics
from threadloom.sources import splits, text


@pytest.fixture
def small_splits(spark):
    """Splits of about 200 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}

    def switch(on):
        for k, v in keys.items():
            if on:
                spark.conf.set(k, v)
            elif old[k] is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, old[k])

    yield switch
    switch(False)


def test_lines_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(2)
    lines = ["".join(rng.choices("ab \té\r", k=rng.randrange(0, 90))) for _ in range(400)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode() + b"\n")
    (tmp_path / "b.txt").write_bytes(b"one\n\ntwo")
    (tmp_path / "c.txt").write_bytes(b"")
    got = {}
    for on in (False, True):
        small_splits(on)
        df = splits.numbered_lines(spark, str(tmp_path))
        assert (df.rdd.getNumPartitions() > 50) == on
        got[on] = sorted((r.file.rsplit("/", 1)[1], r.at, r.line) for r in df.collect())
    assert got[True] == got[False] == sorted([("a.txt", i, x) for i, x in enumerate(lines)] + [("b.txt", i, x) for i, x in enumerate(["one", "", "two"])])
    whole = sorted((r.at, r.line) for r in splits.numbered_lines(spark, str(tmp_path), across=True).collect())
    assert whole == list(enumerate([*lines, "one", "", "two"]))


def test_records_over_splits(spark, tmp_path, small_splits):
    """Records of three lines that lie across splits."""
    (tmp_path / "r.txt").write_text("".join(f"c{i} d{i}\nw{i} x{i} y{i}\n\n" for i in range(120)))
    small_splits(True)
    src, trg = text.triples(splits.numbered_lines(spark, str(tmp_path)))
    assert sorted(map(tuple, src.collect())) == [(i, k, f"{w}{i}") for i in range(120) for k, w in enumerate("wxy")]
    assert sorted(map(tuple, trg.collect())) == [(i, k, c) for i in range(120) for k, c in enumerate(["NULL", f"c{i}", f"d{i}"])]


def test_blocks_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    blocks = [[[rng.randrange(1000) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 6))] for _ in range(50)]
    body = "\n\n\n".join("\n".join(" ".join(map(str, line)) for line in b) for b in blocks)
    (tmp_path / "s.txt").write_text("\n \n" + body + "\n\n")
    small_splits(True)
    got = sorted((r.pair_index, r.k, r.frame) for r in splits.number_blocks(splits.numbered_lines(spark, str(tmp_path))).collect())
    assert got == [(p, k, x) for p, b in enumerate(blocks) for k, x in enumerate(itertools.chain(*b))]


def test_running_sum(spark):
    rows = [(f, a, (a * 7) % 5) for f in (0, 1) for a in range(f, 500, 3)]
    df = spark.createDataFrame(rows, "file int, at long, x long").repartition(5)
    got = sorted((r.file, r["at"], r.before) for r in splits.running_sum(df, F.col("x"), "before", size=16).collect())
    want, total = [], {0: 0, 1: 0}
    for f, a, x in rows:
        want.append((f, a, total[f]))
        total[f] += x
    assert got == sorted(want)


def test_class_scores(spark):
    """Against lists of pairs and sets."""
    rng = random.Random(5)
    found = [(p, 3 * i, 3 * i + rng.randrange(1, 4), rng.randrange(3)) for p in range(6) for i in range(5)]
    units = [(p, t, rng.choice("ab")) for p in range(6) for t in range(20)]
    gold = [(p, a, b) for p in range(6) for a, b in [(0, 2), (2, 5), (5, 9)]]
    at = {(p, t): u for p, t, u in units}
    words = lambda rows: [" ".join(at[r[0], t] for t in range(r[1], r[2])) for r in rows]
    f = spark.createDataFrame(found, "pair_index long, start long, end long, cls long")
    g = spark.createDataFrame(gold, "pair_index long, start long, end long")
    u = spark.createDataFrame(units, "pair_index long, pos long, token string")
    ft, gt = metrics.transcribed(f, u), metrics.transcribed(g, u)
    assert sorted(tuple(r) for r in ft.collect()) == sorted((*r, w) for r, w in zip(found, words(found)))
    pairs = list(itertools.combinations(list(zip((r[3] for r in found), words(found))), 2))
    hit, same, equal = (sum(map(t, pairs)) for t in (lambda p: p[0] == p[1], lambda p: p[0][0] == p[1][0], lambda p: p[0][1] == p[1][1]))
    r = metrics.grouping_prf(ft).first()
    assert (r.precision, r.recall) == pytest.approx((hit / same, hit / equal))
    edges = lambda rows: {(r[0], e) for r in rows for e in r[1:3]}
    r = metrics.edge_prf(f, g).first()
    assert (r.precision, r.recall) == pytest.approx((len(edges(found) & edges(gold)) / len(edges(found)), len(edges(found) & edges(gold)) / len(edges(gold))))
    a, b = set(words(found)), set(words(gold))
    r = metrics.type_prf(ft, gt).first()
    assert (r.precision, r.recall) == pytest.approx((len(a & b) / len(a), len(a & b) / len(b)))
    none = metrics.grouping_prf(ft.where("false")).first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)
