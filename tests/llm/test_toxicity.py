"""Toxicity: held-out accuracy, located sentences, edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import toxicity
from threadloom.llm.queries import op7_toxicity
from threadloom.llm.toxicity import Bags, Model, bag, choose_features, drop_toxic, fit, likelihood, score, score_text, train


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = op7_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    caught = sum(r.predicted for r in test if r.toxic == 1) / sum(r.toxic == 1 for r in test)
    wrong = sum(r.predicted for r in test if r.toxic == 0) / sum(r.toxic == 0 for r in test)
    assert caught > 0.85
    assert wrong < 0.01
    assert all(0 <= r.score <= 1 for r in got)


def test_locates_sentences(spark):
    texts = [f"Good day number {i}. " + ("You foul grobian! " if i % 2 else "You fine fellow! ") + "Bye now." for i in range(60)]
    model = train(spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id long, text string, y int"))
    docs = spark.createDataFrame([(1, texts[1]), (2, texts[2])], "doc_id bigint, text string")
    got = {r.doc_id: r for r in score(docs, model, spans=True).collect()}
    assert got[1].score > 0.9 > 0.1 > got[2].score
    assert [texts[1][s.start : s.end].strip() for s in got[1].spans] == ["You foul grobian"]
    assert not got[2].spans


def plain_features(text):
    """Words of letters only, and their beginnings of 3 to 6 letters."""
    return {f for w in re.findall(r"[^\W\d_]+", text.lower()) for f in [w] + [w[:n] + "*" for n in (3, 4, 5, 6) if len(w) > n]}


def plain_score(weights, bias, leak, text):
    """1 - (1 - leak) times the product over sentences that have a feature of
    1 - sigmoid(sum of weights)."""
    off = 1 - 1 / (1 + math.exp(-leak))
    for p in re.split(r"[.!?\n]", text):
        if found := plain_features(p) & set(weights):
            off *= 1 - 1 / (1 + math.exp(-bias - sum(weights[f] for f in sorted(found))))
    return 1 - off


def test_scores_against_plain_noisy_or(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == pytest.approx(plain_score(model.weights, model.bias, model.leak, r.text), abs=1e-9)


def test_choice_against_plain_counts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("text", F.col("toxic").cast("int").alias("y"))
    got = choose_features(rows, 3, 2.0, 50)
    count = {0: Counter(), 1: Counter()}
    n = Counter()
    for r in rows.collect():
        count[r.y].update(plain_features(r.text))
        n[r.y] += 1
    gain = {}
    for f, c1 in count[1].items():
        c0 = count[0][f]
        p = (c1 + c0 + 1) / (n[1] + n[0] + 2)
        g = (c1 / n[1] - c0 / n[0]) / math.sqrt(p * (1 - p) * (1 / n[1] + 1 / n[0]))
        if c1 + c0 >= 3 and g >= 2:
            gain[f] = g
    assert len(got) == min(50, len(gain))
    assert [gain[f] for f in got] == pytest.approx(sorted(gain.values(), reverse=True)[:50])


def test_likelihood_and_gradient():
    """Against products over sentences, and central differences."""
    texts = ["foul word. fine word! foul foul\nnothing here", "fine. fine. fine", "", "grim. grim foul. plain", "plain text only"]
    labels = [1, 0, 0, 1, 0]
    index = {"foul": 0, "fine": 1, "grim": 2, "fou*": 3}
    heads = {f.rstrip("*")[:3] for f in index}
    bags = Bags.of([(y, *bag(index, heads, t)) for t, y in zip(texts, labels, strict=True)])
    theta = np.array([0.7, -0.4, 1.1, 0.2, -1.3, -2.1])
    weights = dict(zip(index, theta, strict=False))

    def plain(t, decay=0.01):
        w = dict(zip(index, t, strict=False))
        p = [plain_score(w, t[-2], t[-1], x) for x in texts]
        return float(np.mean([math.log(q if y else 1 - q) for q, y in zip(p, labels, strict=True)]) - decay / 2 * sum(v * v for v in t[:-2]))

    value, g = likelihood(bags, theta, 0.01)
    assert weights
    assert value == pytest.approx(plain(theta))
    for i in range(len(theta)):
        e = np.zeros(len(theta))
        e[i] = 1e-5
        assert g[i] == pytest.approx((plain(theta + e) - plain(theta - e)) / 2e-5, abs=1e-8)


def test_sample_has_different_texts(spark, monkeypatch):
    """One text repeated 1,000 times, with the first ids by hash, counts once."""
    texts = [(i, f"text number {i}" if i >= 2000 else f"hot {i % 2}") for i in range(2400)]
    docs = spark.createDataFrame(texts + [(7, "hot 1")] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id bigint, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda sample, most: seen.extend(sample.collect()))
    fit(docs, labels, positive=40, negative=60, spare=100)
    assert len({r.text for r in seen}) == len(seen) == 100
    assert sum(r.y for r in seen) == 40
    assert all(zlib.crc32(str(r.id).encode()) % 3 != 1 for r in seen)


@pytest.mark.parametrize("text", ["", " ", "." * 50_000, " " * 100_000 + "x", "word " * 50_000, "ß İ 漢字"])
def test_any_text(text):
    m = Model({"bad": 9.0, "bad*": 1.0}, -4.0)
    assert 0 <= score_text(m, m.word_scores(), text) <= 1
    assert score_text(m, m.word_scores(), text + "\nBAD") > 0.9


def test_length_is_no_evidence(spark):
    """Clean sentences score alike in any number; one offending sentence among
    100,000 is found and located."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    words = model.word_scores()
    clean = {n: score_text(model, words, "a b c. " * n) for n in (0, 1, 1_000, 100_000)}
    assert max(clean.values()) - min(clean.values()) < 0.01 and max(clean.values()) < 0.3
    bad = max((s for r in docs.collect() for s in toxicity.sentence_probs(model, words, r.text) if s[2] > 0.9), key=lambda s: s[2], default=None)
    assert bad is not None
    text = next(r.text[s[0] : s[1]] for r in docs.collect() for s in toxicity.sentence_probs(model, words, r.text) if s[2] == bad[2])
    long = "a b c. " * 50_000 + text + ". " + "a b c. " * 50_000
    got, found = toxicity.judged(model, words, long)
    assert got > 0.8 and [long[s:e].strip() for s, e, p in found if p > 0.5] == [text.strip()]


def test_long_words_are_not_kept():
    words = Model({"bad": 9.0, "bad*": 1.0}, -4.0).word_scores()
    for i in range(50):
        words.total({"bad" + "x" * 100_000 + str(i)})
    assert sum(map(len, words)) < 1000


def test_edges(spark):
    labels = spark.createDataFrame([(1, 0, 1), (None, 0, 1), (2, 1, None)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(1, "x"), (2, None), (None, "y"), (2, None), (3, "")], "doc_id bigint, text string").withColumns({"score": F.lit("clash"), "_y": F.lit(1)})
    for lab in (labels, labels.where("false")):
        model = fit(docs, lab)
        assert score(docs, model).count() == 5
        kept = drop_toxic(docs, model, 1.1)
        assert kept.columns == docs.columns
        assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert score(docs.where("false"), model).count() == 0
