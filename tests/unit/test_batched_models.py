"""Models over many rows at once: the same sums as row by row."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from threadloom.operators import corrlda, hmm, neural, segmental


def batch(x, y):
    return pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x), pa.array(y)], ["pair_index", "x", "y"])


def test_attention_of_a_batch_is_the_sum_of_its_rows():
    x, y = [[0, 5, 5, 2], [1], [3, 2, 0, 0], [4, 4]], [[1, 3, 0], [2], [0, 1, 1], [3]]
    w = neural.start_net(S=(6, 3), Q=(5, 3), A=(3, 3), O=(4, 4))
    got = defaultdict(float)
    for part in neural.attention_sums(w, batch(x, y)):
        for k, v in part.items():
            got[k] = got[k] + v
    rows = [neural.attention_gradient(w, a, b) for a, b in zip(x, y)]
    assert got["n"][0] == 4 and got["value"][0] == pytest.approx(sum(v for v, _ in rows))
    for k in w:
        np.testing.assert_allclose(got[k], sum(g[k] for _, g in rows), atol=1e-12)


def test_attended_takes_the_lower_of_equal_positions(spark):
    w = neural.start_net(S=(6, 3), Q=(5, 3), A=(3, 3), O=(4, 4))
    rows = [(0, [2, 2, 2], [1, 3]), (1, [1, 0, 1, 4], [0]), (2, [3], [2, 2, 1])]
    got = {r.pair_index: r.out for r in neural.attended(spark.createDataFrame(rows, "pair_index long, x array<int>, y array<int>"), w).collect()}
    assert got == {i: neural.attention(w, x, y)[0].round(12).argmax(1).tolist() for i, x, y in rows}
    assert got[0] == [0, 0]


def test_lists_without_python_objects():
    c = pa.array([[1, 2], None, [], [3, 4, 5], [6, 7]]).slice(1)
    n, first, values = hmm.nested(c)
    assert n.tolist() == [0, 0, 3, 2] and values.tolist() == [3, 4, 5, 6, 7]
    assert {s: r.tolist() for s, r in hmm.of_one_shape(n, n)} == {(0, 0): [0, 1], (2, 2): [3], (3, 3): [2]}
    assert hmm.picked(first[[3]], 2, values).tolist() == [[6, 7]]
    assert hmm.lists(n, values, pa.int64()).to_pylist() == [[], [], [3, 4, 5], [6, 7]]
    assert hmm.nested(pa.array([[[1.0, 2.0]], [[3.0, 4.0], [5.0, 6.0]]]))[2].shape == (3, 2)


def test_decoded_rows_keep_their_order_and_empty_ones(spark):
    p = hmm.start([1, 2], 3, 4, 3, "table", seed=1)
    eye = np.eye(3).tolist()
    rows = [(7, [0, 1, 2], [eye[0], eye[1]]), (3, [], [eye[1]]), (5, [2], [eye[2]]), (9, [1, 1, 3], [eye[2], eye[0]]), (1, [2, 2], [])]
    df = spark.createDataFrame(rows, "pair_index long, x array<int>, y array<array<double>>").coalesce(1)
    got = {r.pair_index: (len(r.alignment), r.concepts) for r in hmm.decode(df, p).collect()}
    assert got == {7: (3, [0, 1]), 3: (0, []), 5: (1, [2]), 9: (3, [2, 0]), 1: (0, [])}


def test_posterior_rows_of_any_shape(spark):
    eye = np.eye(3).tolist()
    rows = [(i, [i % 4, (i + 1) % 4][: 1 + i % 2], [eye[i % 3], eye[(i + 1) % 3]][: 1 + i % 3 % 2]) for i in range(12)]
    df = spark.createDataFrame(rows, "pair_index long, x array<int>, y array<array<double>>")
    m, post, _ = corrlda.train(df, corrlda.start([1, 2], 3, np.eye(3)[:, None, :] * 0.8, 0.1, v=4), 2)
    got = {r.pair_index: r for r in post.collect()}
    assert all(np.allclose(got[i].x, x) and got[i].y == y and len(got[i].align) == len(x) * len(y) and len(got[i].z) == 3 * len(y) for i, x, y in rows)
    assert {r.pair_index: (len(r.alignment), len(r.concepts)) for r in corrlda.decode(post, m).collect()} == {i: (len(x), len(y)) for i, x, y in rows}


def test_segments_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(segmental, "SEGMENTS", 4)
    rows = [(i, [[float(i), float(j)] for j in range(3)], [0, 1, 2, 3]) for i in range(5)]
    df = spark.createDataFrame(rows, "pair_index long, x array<array<double>>, marks array<int>")
    got = {(r.pair_index, r.start, r.end): r.vec for r in segmental.embed_segments(df, 2, "interpolate", 2).collect()}
    assert set(got) == {(i, s, e) for i in range(5) for s in range(3) for e in range(s + 1, min(3, s + 2) + 1)}
    assert got[4, 0, 2] == [4.0, 4.0, 0.0, 1.0]
