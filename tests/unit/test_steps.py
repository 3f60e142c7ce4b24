"""Rows of any lengths that advance together against the same rows one by one."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from threadloom.operators import hmm
from threadloom.plans import models

X = [[0, 2, 1], [3], [1, 1, 0, 2, 3], [2, 0], [0], [3, 1, 2], [], [2, 2]]
Y = [[0, 2], [1, 2], [0, 1], [2], [0, 1, 2], [1, 2], [1], []]


def batch(x, y):
    kind = pa.list_(pa.int32()) if all(isinstance(v, int) for r in y for v in r) else pa.list_(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x, pa.list_(pa.int32())), pa.array(y, kind)], ["pair_index", "x", "y"])


def sums(p, b, **kw):
    total = defaultdict(float)
    for _, s, x, y in hmm.batches(b):
        for k, v in hmm.expected_counts(p, s, x, y, **kw).items():
            total[k] = total[k] + v
    return total


@pytest.mark.parametrize("tied", [False, True])
@pytest.mark.parametrize(("kind", "emission"), [("table", "unigram"), ("linear", "unigram"), ("linear", "bigram"), ("rbf", "unigram"), ("mlp", "bigram")])
def test_rows_together_and_types_as_vectors(kind, emission, tied):
    p = hmm.start([1, 2, 3], 3, 4, 3, kind, emission, hidden=4, seed=3)
    hot = [[np.eye(3)[k].tolist() for k in r] for r in Y]
    got, alone = sums(p, batch(X, Y), tied=tied), defaultdict(float)
    for x, y in zip(X, hot, strict=True):
        for k, v in sums(p, batch([x], [y]), tied=tied).items():
            alone[k] = alone[k] + v
    assert set(got) == set(alone) and got["n"][0] == 6
    for k in alone:
        np.testing.assert_allclose(got[k], alone[k], atol=1e-12)


def test_one_batch_a_number_of_targets():
    assert [(rows.tolist(), s.n.tolist()) for rows, s, _, _ in hmm.batches(batch(X, Y))] == [([3], [1, 1]), ([2, 0, 5, 1], [4, 3, 3, 1, 1]), ([4], [1])]
    assert [len(rows) for rows, *_ in hmm.batches(batch(X, Y), most_bytes=1)] == [1] * 6


def test_paths_together():
    r = np.random.default_rng(5)
    lengths, init, trans = np.array([6, 4, 4, 1]), r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3)
    s, em = hmm.Steps(lengths), r.random((3, lengths.sum()))
    path = hmm.viterbi_steps(init, trans, em, s)
    for i, n in enumerate(lengths):
        assert path[s.row == i].tolist() == hmm.viterbi(init, trans, em[:, s.row == i].T[None])[0].tolist() and n == (s.row == i).sum()


def test_impossible_steps_count_evenly():
    p = hmm.start([2], 2, 2, 2, "table")
    p.obs = np.array([[1.0, 0.0], [1.0, 0.0]])
    moves = sums(p, batch([[0, 1], [0, 0]], [[0, 1], [0, 1]]))["trans/2"]
    np.testing.assert_allclose(moves, np.full((2, 2), 0.5), atol=1e-12)


@pytest.mark.parametrize("size", [1, 2, 3, 11])
def test_orders_over_batches(size):
    lines = [(None, 0, 1), (None, 1, 0), (0, 1, 2), (4, 3, 1), (4, 0, 1), (4, 2, 0), (4, 3, 2), (5, 1, None), (9, 0, None), (9, 2, 1), (9, 1, 1)]
    t = pa.table({"l_orderkey": pa.array([k for k, _, _ in lines], pa.int64()), "code": pa.array([4 * (x + 1) + (0 if y is None else y + 1) for _, x, y in lines], pa.int64())})
    got = [r for b in models._whole_orders(iter(t.to_batches(max_chunksize=size)), 3) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in got] == [(None, [0, 1], [0, 1]), (0, [1], [2]), (4, [3, 0, 2, 3], [0, 1, 2]), (5, [1], []), (9, [0, 2, 1], [1])]


def test_order_ids_without_brand_or_type(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "b", "u"), (2, None, "v"), (3, "a", None)], "p_partkey long, p_brand string, p_type string").write.parquet(f"{d}/part.parquet")
    lines = [(7, 2, 1), (7, 1, 2), (7, 3, 3), (7, 3, 1), (8, 1, 3), (9, 1, 5)]
    spark.createDataFrame([(*r, "1995-01-01") for r in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate string").write.parquet(f"{d}/lineitem.parquet")
    got = lambda **kw: {r.pair_index: (r.x, r.y) for r in models.order_ids(spark, d, **kw)[0].collect()}
    assert got() == {7: ([1, 1, 0], [0]), 8: ([0], [])}
    assert got(unknown=True) == {7: ([-1, 1, 1, 0], [0, 1]), 8: ([0], [])}
