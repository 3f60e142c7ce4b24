"""Near-dedup against brute force, and its edge cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm.components import components
from threadloom.llm.minhash import Plan, drop_near, most_flips, near_groups

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    w = min(width, len(words))
    return {tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if words else set()


def brute(rows, threshold, width):
    sets = {i: sets_of(t, width) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    top[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("threshold", "width"), [(85, 3), (80, 5)])
def test_matches_brute_force(spark, sf, threshold, width):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], threshold, width)
    got = near_groups(docs, threshold, width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)
    assert any(not r.kept for r in got)


def family(n, words=60):
    """Near copies around a base: copy i has its own words at two places."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        t[(7 * i) % words] = f"x{i}"
        if i % 3 == 0:
            t[(11 * i + 5) % words] = f"y{i}"
        out.append((i, " ".join(t)))
    return out


def test_chains_and_blocks(spark):
    rows = family(90)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    for kw in ({}, {"forest": 8, "block": 8}, {"forest": 8}, {"block_bytes": 4000}):  # a bucket in one block, and in many
        got = near_groups(docs, 85, 3, **kw).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 85, 3)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "a b"), (6, "a b c d e f g h"), (6, "a b c d e f g h"), (None, "one"), (7, " \t\n"), (8, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).withColumns({"text_": F.lit(1), "component_id": F.lit("clash"), "kept": F.lit(0)})
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_groups(docs, 85, 3).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 6, 6, True), (None, 1, None, True), (7, 0, 7, True), (8, 1, 8, True)}
    assert sorted(r.doc_id or 0 for r in drop_near(docs).collect()) == [0, 1, 2, 3, 5, 6, 6, 7, 8]
    assert drop_near(docs).columns == docs.columns
    assert near_groups(docs.where("false"), 85, 3).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 7), (50, 60), (60, 61), (9, 9), (70, None)], "a bigint, b bigint")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 1 for i in [*range(1, 41), 100]}, 50: 50, 60: 50, 61: 50}


def test_plan_keeps_links():
    for t in (80, 85, 90):
        p = Plan(t, 5)
        assert (1 - (t / 100) ** p.rows) ** (p.samples // p.rows) <= 1e-8
        assert p.flips < p.bits // 2


def test_screen_loses_no_link():
    """The screen's bound against simulated pairs at the threshold: samples that
    differ, flips that meet; its chance is met at a level that can be counted."""
    rng = np.random.default_rng(12)
    for t in (80, 85):
        p = Plan(t, 5)
        n = 40_000
        differ = rng.binomial(p.samples, 1 - t / 100, n)
        odd = np.array([(np.bincount(rng.integers(0, p.bits, 2 * d), minlength=p.bits) & 1).sum() for d in differ])
        assert odd.max() <= p.flips
        for miss in (1e-2, 1e-3):
            bound = most_flips(1 - t / 100, p.samples, p.bits, miss)
            assert (odd > bound).mean() <= miss + 4 * (miss / n) ** 0.5
            assert (odd >= bound).mean() >= miss - 4 * (miss / n) ** 0.5


def test_screen_on_sketches():
    """Sets exactly at the threshold pass the screen."""
    rng = np.random.default_rng(13)
    p = Plan(80, 5)
    mult = p.multipliers()
    for _ in range(150):
        s = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        a, b = p.odd_sketch(p.signature(np.sort(s[:108]), mult)), p.odd_sketch(p.signature(np.sort(s[12:]), mult))
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= p.flips


def test_crowd_without_links(spark):
    """Pages that share boilerplate, too many for a block: same links as brute
    force, through rare shingles."""
    boiler = [f"b{i}" for i in range(70)]
    rows = [(i, " ".join([*boiler, *(f"u{i}x{k}" for k in range(30))])) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(f"u{i}x29", "tail")) for i in range(0, 60, 7)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    want = brute(rows, 85, 3)
    assert len({c for _, c in want.values()}) == 60
    got = near_groups(docs, 85, 3, block=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_tables_are_removed(spark, sf):
    """Near-dedup leaves the two tables its result reads, and no others."""
    import os

    from threadloom.llm.common import shared_dir

    top = f"{shared_dir(spark)}/threadloom-{spark.sparkContext.applicationId}".removeprefix("file:")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    out = near_groups(spark.read.parquet(f"{sf}/documents.parquet"), 85, 3)
    assert out.count() == 200
    left = set(os.listdir(top)) - before
    assert len([p for p in left if not p.startswith(".")]) == 2


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from threadloom.llm.common import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session)
