"""Networks by numeric gradients and enumeration; media formats by round trips."""

import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import neural, segmental
from threadloom.sources import media


def check_gradient(w, f):
    _, g = f(w)
    rng = np.random.default_rng(0)
    for k, v in w.items():
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in v.shape)
            up, down = ({n: x.copy() for n, x in w.items()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[k][at] == pytest.approx((f(up)[0] - f(down)[0]) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("labels", [[], [1], [2, 2], [1, 2, 1]])
def test_ctc_by_enumeration(labels):
    rng = np.random.default_rng(1)
    for t in (3, 5):
        logp = np.log(rng.dirichlet(np.ones(3), t))
        total = 0.0
        for path in itertools.product(range(3), repeat=t):
            if [s for i, s in enumerate(path) if s and (i == 0 or s != path[i - 1])] == labels:
                total += np.exp(logp[np.arange(t), path].sum())
        assert np.exp(neural.ctc(logp, labels)[0]) == pytest.approx(total)


def test_gradients():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 4))
    check_gradient(neural.start_net(W1=(5, 13), W2=(4, 6)), lambda w: neural.tdnn_gradient(w, x, [1, 3, 3]))
    check_gradient(neural.start_net(S=(6, 3), Q=(5, 3), A=(3, 3), O=(4, 4)), lambda w: neural.attention_gradient(w, [0, 5, 5, 2], [1, 3, 0]))
    image = rng.normal(size=(8, 8))
    check_gradient(neural.start_net(F=(4, 10), D=(3, 37)), lambda w: neural.convolved_gradient(w, image, 2))


def test_training_learns(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        y = [int(v) for v in rng.integers(1, 4, 3)]
        x = np.concatenate([np.eye(4)[[c, 0]] for c in y]) + rng.normal(0, 0.05, (6, 4))
        rows.append((i, x.tolist(), y))
    df = spark.createDataFrame(rows, "pair_index long, x array<array<double>>, y array<int>")
    w, history = neural.train_net(df, neural.start_net(W1=(12, 13), W2=(4, 13)), lambda w, r: neural.tdnn_gradient(w, np.array(r["x"]), r["y"]), 60, rate=0.05)
    assert history[-1] > history[0]
    got = {r.pair_index: r.out for r in neural.apply_net(df, w, lambda w, r: neural.greedy(neural.tdnn(w, np.array(r["x"]))[0])).collect()}
    assert sum(got[i] == y for i, _, y in rows) > 50
    assert neural.train_net(df.where("false"), w, lambda w, r: (0.0, w), 2)[1] == []


def test_segment_training(spark):
    """Means move to the segments' own, and segmentations stop changing."""
    rng = np.random.default_rng(4)
    true = {"a": np.array([1.0, 0, 0]), "b": np.array([0, 1.0, 0])}
    rows = []
    for i in range(30):
        x = np.concatenate([np.repeat(true["a"][None], 4, 0), np.repeat(true["b"][None], 3, 0)]) + rng.normal(0, 0.02, (7, 3))
        rows.append((i, x.tolist(), list(range(8)), ["a", "b"]))
    pairs = spark.createDataFrame(rows, "pair_index long, x array<array<double>>, marks array<int>, concepts array<string>")
    for kind in ("kmeans", "gmm", "hmm"):
        first = {c: np.repeat(v + 0.2, 2)[None] for c, v in true.items()}
        models = segmental.train_segments(pairs, first, 2, 5, kind, "interpolate", longest=7)
        for c, v in true.items():
            assert np.abs(models[c][0] - np.repeat(v, 2)).max() < 0.05
        got = segmental.segment_all(pairs, models, 2, kind, "interpolate", longest=7).collect()
        assert all((r.concept == "a") == (r.end <= 4) for r in got)


def test_mat(spark):
    m = {"one": np.arange(6.0).reshape(2, 3), "two": np.array([[7.5]])}
    data = media.make_mat(m)
    body = data[128:]
    size = 8 + struct.unpack("<I", body[4:8])[0]
    packed = zlib.compress(body[:size])
    small = data[:128] + struct.pack("<II", 15, len(packed)) + packed + body[size:]
    for d in (data, small):
        got = media.parse_mat(d)
        assert all((got[k] == v).all() for k, v in m.items())
    files = spark.createDataFrame([("f", bytearray(data))], "path string, content binary")
    assert [(r.name, r.vec) for r in media.mat_matrices(files).orderBy("name", "pos").collect()] == [("one", [0, 1, 2]), ("one", [3, 4, 5]), ("two", [7.5])]
    with pytest.raises(ValueError, match="MAT"):
        media.parse_mat(b"short")


def test_features_to_wave():
    t = np.arange(1024)
    x = np.sin(2 * np.pi * t / 16)
    window = np.hanning(129)[:128]
    frames = np.stack([x[i : i + 128] * window for i in range(0, 1024 - 127, 32)])
    mel = np.abs(np.fft.rfft(frames, axis=1))
    y = media.features_to_wave(mel, 128, 32)
    again = np.abs(np.fft.rfft(np.stack([y[i : i + 128] * window for i in range(0, len(y) - 127, 32)]), axis=1))
    assert np.abs(again[2:-2] - mel[2:-2]).mean() < 0.05 * mel.max()


def test_png_and_report(spark):
    p = media.png(np.array([[0, 255], [300, -5]]))
    assert p[:8] == b"\x89PNG\r\n\x1a\n"
    at = p.index(b"IDAT")
    assert zlib.decompress(p[at + 4 : at + 4 + struct.unpack(">I", p[at - 4 : at])[0]]) == b"\0\x00\xff\0\xff\x00"
    df = spark.createDataFrame([(1, 1, "<b>"), (1, 0, None)], "pair_index long, pos long, token string")
    assert media.html_report(df, ["token"]).first().html == "<table><tr><th>token</th></tr><tr><td></td></tr><tr><td>&lt;b&gt;</td></tr></table>"


def test_sqlite(spark):
    df = spark.createDataFrame([(1, 5, "x", None), (1, 6, None, 2.5), (2, 7, "y", 0.0)], "k long, a long, b string, c double")
    files = media.write_sqlite(df, "k", "t")
    got = media.sqlite_rows(files, "t", {"a": "long", "b": "string", "c": "double"}).orderBy("a").collect()
    assert [(r.path, r.a, r.b, r.c) for r in got] == [("1", 5, "x", None), ("1", 6, None, 2.5), ("2", 7, "y", 0.0)]
    assert files.select(F.length("content")).first()[0] > 0
