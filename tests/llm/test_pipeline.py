"""The pipeline against a brute-force version of its stages."""

import hashlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near import brute
from tests.llm.test_toxicity import plain_score
from threadloom.llm.bpe import encoder
from threadloom.llm.mixing import mix
from threadloom.llm.toxicity import fit

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = [{i: t for i, t in rows.items() if plain_score(model.weights, model.bias, model.leak, t) < 0.7}]
    first: dict = {}
    for i in sorted(want[0]):
        first.setdefault(lower(want[0][i]), i)
    want.append({i: want[0][i] for i in first.values()})
    groups = brute(sorted(want[1].items()), 80, 5)
    want.append({i: t for i, t in want[1].items() if groups[i][1] == i})
    want.append(want[2])
    for (name, stage), left in zip(corpus_pipeline.STAGES, want, strict=False):
        out = stage(spark, docs, sf)
        assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert {r.doc_id: r.text for r in docs.collect()} == left, name
    assert len(want[0]) < len(rows)
    assert len(want[2]) < len(want[1]) < len(want[0])
    enc = encoder(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect():
        t = want[-1][r.doc_id]
        assert list(r.tokens) == enc.encode_ordinary(t)
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(want[-1])


def test_mix_survives_the_reread(spark, sf, tmp_path):
    """The mixing stage's order, from several files read in any order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [tuple(r) for r in mix(docs, carry=["doc_id"]).orderBy(*corpus_pipeline.PLACE).select("row.doc_id", *corpus_pipeline.PLACE).collect()]
    corpus_pipeline.mixing(spark, docs, sf).write.option("maxRecordsPerFile", 15).parquet(str(tmp_path / "mixed"))
    again = spark.read.parquet(str(tmp_path / "mixed"))
    assert len(again.inputFiles()) > 10
    for read in (again, again.orderBy(F.desc("n_chars"))):
        got = corpus_pipeline.encoding(spark, read, sf).select("doc_id", *corpus_pipeline.PLACE).collect()
        assert [tuple(r) for r in got] == want
    assert len({w[1] for w in want}) > 5


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, sf, k):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", None, "a", None), (3, "same text", "en", None, 9), (4, "SAME TEXT", "en", "b", 9), (5, "x " * 60_000, "en", "b", 1)]
    rows += [(3, "same text", "en", None, 9)] * 2  # repeated rows stay or go together
    docs = spark.createDataFrame(rows, schema).withColumns({"odd.name": F.lit(1), "text_": F.lit("x"), "_id": F.lit(2), "slot": F.lit(3), "size": F.lit(4)})
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf)
    assert k == 4 or out.columns == docs.columns
    kept = sorted(str(r.doc_id) for r in out.collect())
    assert kept == sorted(["1", "None", "3", "3", "3", "5"] + ["2"] * (k != 1) + ["4"] * (k not in (1, 2)))
    assert corpus_pipeline.STAGES[k][1](spark, docs.where("false"), sf).count() == 0
