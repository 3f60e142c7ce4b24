"""Rounds over pairs in rows: token tables joined, what is left on disk."""

import glob

import numpy as np
import pytest

from threadloom.operators import variational
from threadloom.sources.shared import release, shared_dir, stored


def inputs(spark):
    r = np.random.default_rng(2)
    src, reg = [], []
    for i in range(30):
        src += [(i, t, f"w{r.integers(0, 5)}") for t in range(r.integers(0, 5))]
        reg += [(i, t, r.normal(0, 1, 2).tolist()) for t in range(r.integers(0, 4))]
    return spark.createDataFrame(src, "pair_index long, spos long, token string"), spark.createDataFrame(reg, "pair_index long, tpos long, vec array<double>")


def test_joined_token_table(spark, monkeypatch):
    found = []
    for most in (variational.SENT, 0):
        monkeypatch.setattr(variational, "SENT", most)
        post, q, p = variational.rounds(*inputs(spark), [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]], 0.5, 3)
        found.append(({(r.pair_index, r.spos, r.tpos): r.a for r in post.collect()}, {(r.pair_index, r.tpos, i): x for r in q.collect() for i, x in enumerate(r.q)}, {(r.token, i): x for r in p.tokens.collect() for i, x in enumerate(r.p)}))
    for a, b in zip(*found, strict=True):
        assert a and a == pytest.approx(b)


def test_rounds_leave_no_long_tables(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/*/*") + glob.glob(f"{folder}/*"))
    kept = variational.rounds(*inputs(spark), [[1.0, 0.0], [0.0, 1.0]], 0.5, 4)
    new = set(glob.glob(f"{folder}/*/*") + glob.glob(f"{folder}/*")) - before
    assert not [x for x in new if "/rdd-" in x]
    assert len([x for x in new if x.count("/files-") and x.rsplit("/", 1)[1].startswith("files-")]) <= 3  # rows with alignments, words, token table
    assert kept[0].count() > 0


def test_stored_and_released(spark):
    df = stored(spark.range(10).groupBy("id").count())
    assert df.count() == 10
    release(df)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        df.collect()
