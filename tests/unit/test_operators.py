"""Operators on tiny tables worked out by hand; readers, writers, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import em, metrics, segments
from threadloom.operators import encode as E
from threadloom.sources import npz, sinks, text
from threadloom.streaming import incremental


def seq(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame([(0, i, *[c[i] for c in cols.values()]) for i in range(n)], "pair_index long, pos long, " + ", ".join(f"{c} {'string' if isinstance(v[0], str) else 'double' if isinstance(v[0], float) else 'long'}" for c, v in cols.items()))


@pytest.fixture(scope="module")
def toy(spark):
    return seq(spark, gold=[0, 0, 1, 1], pred=[0, 1, 1, 1])


def test_alignment_metrics(toy):
    assert metrics.accuracy(toy).first()[0] == 0.75
    r = metrics.local_prf(toy).first()
    assert (r.recall, r.precision, r.f1) == pytest.approx((0.75, 5 / 6, 0.789474), abs=1e-6)
    assert metrics.purity(toy, "pred", "gold").first()[0] == pytest.approx(0.75)


def test_spans(toy):
    p, g = segments.run_segments(toy, "pred"), segments.run_segments(toy, "gold")
    assert sorted((r.start, r.end) for r in p.collect()) == [(0, 1), (1, 4)]
    assert metrics.word_iou(p, g).first()[0] == pytest.approx((1 / 2 + 2 / 3) / 2)
    r = metrics.segmentation_prf(p, g, 1).first()
    assert (r.recall, r.precision, r.f1) == pytest.approx((0.5, 0.5, 0.5))
    assert metrics.mean_length(p, compat=True).first()[0] == metrics.mean_length(p).first()[0] + 1


def test_trailing_run(spark):
    t = seq(spark, a=[0, 1])
    assert [(r.start, r.end) for r in segments.run_segments(t, "a", emit_trailing=False).collect()] == [(0, 1)]
    assert segments.run_segments(t, "a").count() == 2


def test_boundaries(spark):
    t = seq(spark, boundary=[0, 1, 0, 1])
    assert sorted((r.start, r.end) for r in segments.boundaries_to_spans(t).collect()) == [(0, 2), (1, 4)]


def test_null_values_in_runs(spark):
    t = spark.createDataFrame([(0, 0, None), (0, 1, None), (0, 2, 1)], "pair_index long, pos long, v long")
    assert sorted((r.start, r.end) for r in segments.run_segments(t, "v").collect()) == [(0, 2), (2, 3)]


def test_encoders(spark):
    t = seq(spark, value=[1.0, 2.0, 3.0])
    assert [round(r.value, 2) for r in E.preemphasis(t, "value").orderBy("pos").collect()] == [1.0, 1.03, 1.06]
    v = t.select("pair_index", "pos", F.array("value").alias("vec"))
    assert [r.vec for r in E.stack_context(v, "vec", 1, 1).orderBy("pos").collect()] == [[0, 1, 2], [1, 2, 3], [2, 3, 0]]
    a = seq(spark, token=list("abcd"), alignment=[0, 1, 1, 2])
    assert [(r.token, r.alignment) for r in E.drop_null_aligned(a).orderBy("pos").collect()] == [("b", 0), ("c", 0), ("d", 1)]


def test_ibm1_step(spark):
    src = spark.createDataFrame([(0, 0, "x"), (1, 0, "x"), (1, 1, "y")], "pair_index long, pos long, token string")
    trg = spark.createDataFrame([(0, 0, "NULL"), (0, 1, "A"), (1, 0, "NULL"), (1, 1, "A"), (1, 2, "B")], "pair_index long, pos long, concept string")
    p = {(r.concept, r.token): r.p for r in em.ibm1(src, trg, 1).collect()}
    assert p == pytest.approx({("A", "x"): 5 / 7, ("NULL", "x"): 5 / 7, ("A", "y"): 2 / 7, ("NULL", "y"): 2 / 7, ("B", "x"): 0.5, ("B", "y"): 0.5})
    ll = [em.ibm1_likelihood(src, trg, em.ibm1(src, trg, n)).first()[0] for n in (1, 2, 4)]
    assert ll == sorted(ll)
    assert em.ibm1(src, trg, 50, tolerance=1e-3).count() == 6


def test_roc(spark):
    t = spark.createDataFrame([("c", 0.9, True), ("c", 0.5, False), ("c", 0.5, True), ("c", 0.1, False)], "c string, s double, y boolean")
    got = sorted((r.threshold, r.tpr, r.fpr) for r in metrics.roc_points(t, "s", "y", ["c"]).collect())
    assert got == [(0.1, 1.0, 1.0), (0.5, 1.0, 0.5), (0.9, 0.5, 0.0)]


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b\nx y z\n\nc\nw\n\n")
    src, trg = text.triples(text.lines(spark, str(tmp_path / "t.txt")))
    assert [(r.pair_index, r.token) for r in src.orderBy("pair_index", "pos").collect()] == [(0, "x"), (0, "y"), (0, "z"), (1, "w")]
    assert [(r.pair_index, r.concept) for r in trg.orderBy("pair_index", "pos").collect()] == [(0, "NULL"), (0, "a"), (0, "b"), (1, "NULL"), (1, "c")]
    (tmp_path / "seg.txt").write_text("0 5 9\n\n0\n7\n")
    assert [(r.pair_index, r.frame) for r in text.segment_blocks(spark, str(tmp_path / "seg.txt")).orderBy("pair_index", "k").collect()] == [(0, 0), (0, 5), (0, 9), (1, 0), (1, 7)]
    np.savez(tmp_path / "f.npz", arr_1=np.ones((2, 3)), arr_0=np.zeros((1, 3)))
    got = npz.read_npz(spark, str(tmp_path / "f.npz")).orderBy("pair_index", "pos").collect()
    assert [(r.pair_index, r.pos, r.vec[0]) for r in got] == [(0, 0, 0.0), (1, 0, 1.0), (1, 1, 1.0)]
    assert npz.read_npz(spark, str(tmp_path / "f.npz"), longest=1).count() == 2
    assert npz.write_npz(npz.read_npz(spark, str(tmp_path / "f.npz"))).count() == 2
    (tmp_path / "a.json").write_text('[{"index": 1, "alignment": [0, 1], "align_probs": [[0.5, 0.5]], "image_concepts": ["a"]}]')
    a = text.alignments(spark, str(tmp_path / "a.json"))
    assert a.first().alignment == [0, 1]
    sinks.write_alignments(a.select("index", "alignment"), str(tmp_path / "out"))
    assert text.alignments(spark, str(tmp_path / "out")).count() == 1
    sinks.write_parameters(spark.createDataFrame([("A", "x", 0.5)], "e string, f string, p double"), str(tmp_path / "p"))
    assert text.parameters(spark, str(tmp_path / "p"), "e string, f string, p double").first().p == 0.5


def test_wav(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(1000)
        w.writeframes(np.arange(100, dtype=np.int16).tobytes())
    r = npz.read_wav(spark, str(tmp_path / "x.wav"), 10, 20).first()
    assert (r.rate, r.samples[0], len(r.samples)) == (1000, 10.0, 10)


def test_streams(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = run(incremental.windowed_counts(incremental.event_time(stream), "event_type"), "w", "complete")
    assert got.agg(F.sum("n")).first()[0] == batch.count()
    assert run(incremental.gap_sessions(incremental.event_time(stream), "user_id"), "g", "append").agg(F.sum("n")).first()[0] <= batch.count()
    runs = run(incremental.run_segments(stream.select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id"), "r", "append")
    assert runs.where("end <= start").count() == 0
    from threadloom.plans.corpora import event_tokens

    whole = segments.run_segments(event_tokens(spark, sf), "token")
    assert runs.count() == whole.count() - batch.select("user_id").distinct().count()


def test_ranked_without_checkpoints(spark, monkeypatch):
    t = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    want = {k: i for i, k in enumerate(sorted(r.k for r in t.collect()))}
    assert {r.k: r.n for r in E.ranked(t, ["k"], "n").collect()} == want
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    assert {r.k: r.n for r in E.ranked(t, ["k"], "n").collect()} == want


def test_overlaps_against_all_pairs(spark):
    """Binned interval joins find each overlap once, whatever the bin width."""
    rng = np.random.default_rng(5)
    draw = lambda n: [(int(k), int(s), int(s + w)) for k, s, w in zip(rng.integers(0, 3, n), rng.integers(-50, 300, n), rng.integers(1, 90, n), strict=True)]
    a, b = draw(60), draw(60)
    left, right = spark.createDataFrame(a, "k long, s long, e long"), spark.createDataFrame(b, "rk long, rs long, re long")
    want = sorted((*x, *y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    for width in (1, 7, 1000):
        got = segments.overlapping(left, right, ("k", "rk"), ("s", "e", "rs", "re"), width)
        assert sorted(map(tuple, got.collect())) == want
    points = spark.createDataFrame([(k, p) for k, p, _ in b], "pk long, pos long")
    spans = left.select("k", F.col("s").alias("start"), F.col("e").alias("end"))
    got = segments.covered(spans, points, "k", "pk", 16)
    assert sorted(map(tuple, got.collect())) == sorted((*x, *y[:2]) for x in a for y in b if x[0] == y[0] and x[1] <= y[1] < x[2])


def test_translation_search_fills_up(spark):
    """Pairs without known tokens rank last, at minus infinity, by higher id."""
    from threadloom.operators import retrieval

    params = spark.createDataFrame([("A", "x", 0.5), ("B", "x", 0.25), ("B", "y", 0.5)], "concept string, token string, p double")
    trg = spark.createDataFrame([(1, 0, "A"), (2, 0, "B"), (3, 0, "C"), (4, 0, "B"), (5, 0, "C")], "pair_index long, pos long, concept string")
    src = spark.createDataFrame([(1, 0, "x"), (2, 0, "y"), (3, 0, "?")], "pair_index long, pos long, token string")
    got = retrieval.translation_search(src, trg, params, 4).orderBy("query_id", "rank").collect()
    inf = float("-inf")
    ln = lambda x: round(float(np.log(x)), 9)
    assert [(r.query_id, r.item_id, r.score) for r in got] == [
        (1, 1, ln(0.5)), (1, 4, ln(0.25)), (1, 2, ln(0.25)), (1, 5, inf),
        (2, 4, ln(0.5)), (2, 2, ln(0.5)), (2, 5, inf), (2, 3, inf),
        (3, 5, inf), (3, 4, inf), (3, 3, inf), (3, 2, inf),
    ]


def test_shared_folder(spark):
    from types import SimpleNamespace

    from threadloom.sources.shared import shared_dir

    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(session)
