"""Queries against their SQL on small tables with odd rows."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from threadloom.operators import bigrams, chains, hmm
from threadloom.operators import retrieval as R


def equal(spark, folder, name):
    duck = duckdb.connect()
    for f in folder.glob("*.parquet"):
        duck.execute(f"create view {f.stem} as select * from '{f}'")
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = sorted(map(repr, map(tuple, entry.queries()[name](spark, str(folder)).select(*cols).collect())))
    assert got == want
    return got


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    """Long, short and equal orders, repeated lines."""
    folder = tmp_path_factory.mktemp("orders")
    duck = duckdb.connect()
    duck.execute(f"copy (select i::bigint p_partkey, 'Brand#' || i % 7 p_brand, 'T' || i % 5 p_type, 1::int p_size from range(41) t(i)) to '{folder}/part.parquet' (format parquet)")
    duck.execute(
        f"copy (select (o * 20)::bigint l_orderkey, ((o * 13 + n * n * 3) % 40)::bigint l_partkey, (n % 6 + 1)::int l_linenumber, 1.0::double l_quantity, timestamp '2024-01-01' + to_days(n::int) l_shipdate "
        f"from range(30) t(o), range(23) u(n) where n < 1 + o * o % 23) to '{folder}/lineitem.parquet' (format parquet)"
    )
    return folder


def test_chain_search(spark, orders):
    assert len(equal(spark, orders, "m31_chain_search")) == 60


def test_math_of_odd_values(spark, tmp_path):
    """Below 0, next to halves of the last digit, null, large, minus 0 after rounding."""
    values = "-10.37, -1e-9, 8.0496445, 4412.92, 42377.0, 0.9999999999, 987654321.12345678, null, 0, -0.0, 10"
    duckdb.execute(f"copy (select i::bigint event_id, v::double as value from (select unnest(range(11)) i, unnest([{values}]) v)) to '{tmp_path}/events.parquet' (format parquet)")
    assert len(equal(spark, tmp_path, "p38_math")) == 11


@pytest.mark.parametrize("parts", [2, 40])
def test_jaccard_without_copies(spark, monkeypatch, parts):
    """Many parts and tiles of left rows give what one gives; no side is copied to blocks."""
    monkeypatch.setattr(R, "in_blocks", None)
    r = random.Random(4)
    docs = [(i, r.choice("ab"), [f"w{int(r.paretovariate(0.8)) % 90}" for _ in range(r.randrange(30))]) for i in range(200)]
    df = spark.createDataFrame(docs, "id long, lang string, t array<string>").repartition(6)
    left, right = df.where("id % 3 = 0").selectExpr("lang", "id l_id", "t l_tokens"), df.selectExpr("lang", "id r_id", "t r_tokens")
    got = {x.l_id: (x.r_id, x.sim) for x in R.jaccard_best(left, right, "lang", most_rows=-(-67 // parts)).collect()}
    want = {}
    for i, lang, t in docs[::3]:
        of = [(round(len(set(t) & set(u)) / len(set(t) | set(u)), 9), -j) for j, other, u in docs if t and u and j != i and other == lang]
        if of and max(of)[0] > 0:
            want[i] = (-max(of)[1], max(of)[0])
    assert got == want
    assert R.jaccard_best(left.limit(0), right, "lang").count() == R.jaccard_best(left, right.limit(0), "lang").count() == 0


def test_jaccard_tiles(monkeypatch):
    """Left rows by tiles and right rows by batches, in any order."""
    r = random.Random(5)
    rows = [[f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(r.randrange(12))] for _ in range(90)]
    rows = [sorted(set(x)) for x in rows]
    ids, found = np.arange(90), []
    for tile, order in ((4096, [range(90)]), (7, [range(50, 90), range(20), range(20, 50)])):
        monkeypatch.setattr(R._Nearest, "TILE", tile)
        near = R._Nearest(ids[:40], pa.array(rows[:40], pa.list_(pa.string())))
        best = near.start()
        for part in order:
            near.meet(*best, ids[list(part)], pa.array([rows[i] for i in part], pa.list_(pa.string())))
        found.append([x.tolist() for x in best])
    assert found[0] == found[1]


def share(w):
    return w / w.sum(-1, keepdims=True)


@pytest.fixture(scope="module")
def sources(spark):
    """(pairs of ids, emissions, chain, what the sequential kernels make of each pair)."""
    rng = np.random.default_rng(6)
    obs = share(rng.random((9, 7)) + 0.01)
    chain = {m: (share(rng.random(m) + 0.1), share(rng.random((m, m)) + 0.05)) for m in (1, 2, 4)}
    rows, want = [], {}
    for i, (t, m) in enumerate([(1, 1), (1, 4), (2, 2), (5, 4), (6, 2), (7, 4), (12, 1), (13, 4), (31, 2), (48, 4), (0, 2), (3, 0)]):
        x, y = rng.integers(0, 7, t), rng.choice(9, m, replace=False)
        rows.append((i, x.tolist(), y.tolist()))
        if t and m:
            (init, trans), e = chain[m], obs[y][:, x].T
            a, c = hmm.forward(init, trans, np.eye(m)[None], e[None])
            b = hmm.backward(trans, np.eye(m)[None], e[None], c)
            want[i] = (a * b).sum(-1)[0], np.log(c).sum(), hmm.viterbi(init, trans, e[None])[0]
    return spark.createDataFrame(rows, "pair_index long, x array<int>, y array<int>").repartition(3), obs, chain, want


@pytest.mark.parametrize("held", [6, 4096])
def test_sums_of_sources(monkeypatch, sources, held):
    """Chunks that meet in memory and, of sources of more than one row, in joins."""
    pairs, obs, chain, want = sources
    monkeypatch.setattr(chains, "HELD", held)
    s = chains.sources(pairs, obs, 2)
    assert s.last == {6: 7, 4096: 0}[held]
    post, ll = chains.posteriors(s, chain, 2)
    got = {(r.pair_index, r.pos, r.state): r.post for r in post.collect()}
    assert len(got) == sum(p.size for p, _, _ in want.values())
    assert all(abs(got[i, t, j] - p[t, j]) < 1e-12 for i, (p, _, _) in want.items() for t, j in np.ndindex(p.shape))
    for found in (ll, chains.likelihoods(s, chain, 2)):
        assert {r.pair_index: r.ll for r in found.collect()} == pytest.approx({i: x for i, (_, x, _) in want.items()}, abs=1e-10)


@pytest.mark.parametrize("held", [6, 4096])
def test_paths_of_sources(monkeypatch, sources, held):
    pairs, obs, chain, want = sources
    monkeypatch.setattr(chains, "HELD", held)
    for size in (2, 3):
        got = {(r.pair_index, r.pos): r.state for r in chains.best_paths(chains.sources(pairs, obs, size), chain, size).collect()}
        assert got == {(i, t): j for i, (_, _, path) in want.items() for t, j in enumerate(path.tolist())}


@pytest.mark.parametrize("held,most", [(3, 1 << 20), (4096, 60), (4096, 10), (3, 10)])
def test_bigrams_from_ids(spark, monkeypatch, held, most):
    """As from rows of text: sources of several rows, counts without an array, cells joined."""
    r = random.Random(held + most)
    src, trg, ids = [], [], []
    for p in range(14):
        x, y = [r.randrange(5) for _ in range(r.randint(1, 9))], sorted(r.sample(range(3), r.randint(1, 3)))
        src += [(p, t, "abcd"[k - 1] if k else None) for t, k in enumerate(x)]
        trg += [(p, j, "XYZ"[k]) for j, k in enumerate(y)]
        ids.append((p, x, y))
    chain = {m: (share(np.arange(1.0, m + 1)), share(np.eye(m) + 0.3)) for m in (1, 2, 3)}
    co = bigrams.bigram_cooccurrences(spark.createDataFrame(src, "pair_index long, pos long, token string"), spark.createDataFrame(trg, "pair_index long, pos long, concept string")).cache()
    table = bigrams.train(co, chain, 2)
    want = {(c.concept, c.prev, c.token): c.p for c in table.collect()}
    ll = {x.pair_index: x.ll for x in chains.likelihoods(bigrams.emissions(co, table), chain).collect()}
    monkeypatch.setattr(chains, "HELD", held)
    monkeypatch.setattr(bigrams, "MOST", most)
    coded = bigrams.Coded(spark.createDataFrame(ids, "pair_index long, x array<int>, y array<int>"), 3, 4, chain, min(held, 4096))
    cells = coded.train(2)
    name = ["", *"abcd"]
    assert {("XYZ"[c.concept], name[c.prev], name[c.token]): c.p for c in cells.collect()} == pytest.approx(want, abs=1e-12)
    assert {x.pair_index: x.ll for x in coded.likelihoods(cells).collect()} == pytest.approx(ll, abs=1e-10)
    none = bigrams.Coded(spark.createDataFrame([], "pair_index long, x array<int>, y array<int>"), 3, 4, chain)
    assert none.likelihoods(none.train(1)).count() == 0


@pytest.mark.parametrize("name", ["m16_bigram_table", "m16_bigram_likelihood", "k01_chunked_likelihood", "k09_chunked_paths"])
def test_long_orders(spark, monkeypatch, orders, name):
    """Orders of up to 23 lines, in rows of four positions."""
    monkeypatch.setattr(chains, "HELD", 4)
    equal(spark, orders, name)


def test_kernels_take_cells(monkeypatch):
    """Rows of many states are taken in smaller groups."""
    m, n = np.array([2, 9, 2, 9, 0, 9]), np.array([5, 5, 0, 5, 5, 5])
    assert [g.tolist() for g in chains._groups(m, n)] == [[0], [1, 3, 5]]
    monkeypatch.setattr(chains, "MOST", 500)
    assert [g.tolist() for g in chains._groups(m, n)] == [[0], [1], [3], [5]]
