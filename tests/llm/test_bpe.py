"""BPE against the library on whole texts, exact round trips, edge cases."""

import hashlib
import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from threadloom.llm.bpe import decode_tokens, encode, encode_texts, encoder, safe_parts

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return encoder(open(RANKS, "rb").read(), P.PATTERN)


def test_parts_do_not_change_tokens(enc):
    rng = random.Random(5)
    alphabet = ["a", "Z", "é", "漢", "9", "'s", "'ll", "!", " ", "  ", "\n", "\t", " ", "　", "\x85", "\x1c", "​", "🙂", "word", "."]
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 120)))
        whole = enc.encode_ordinary(text)
        for size in (1, 3, 10):
            assert encode(enc, text, size).tolist() == whole
            assert "".join(safe_parts(text, size)) == text


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 100_000 + "x", "\n" * 50_000, "x " * 100_000, "9" * 70_000, "…" * 70_000])
def test_long(enc, text):
    assert enc.decode_bytes(encode(enc, text).tolist()) == text.encode()


@pytest.mark.parametrize(("left", "space", "right"), [("", " ", "x"), ("x", "\n", ""), ("a ", " \n", "9"), ("", "\n ", "."), ("b", "\u3000\t", "'s"), ("c", "\r\n", "\n x")])
def test_long_white_space(enc, left, space, right):
    """Runs of white space: as the library where it survives, whole beyond."""
    for n in (9_999, 10_000, 10_001, 50_000):
        text = left + space * (n // len(space)) + right
        assert encode(enc, text + " then " + text, 1000).tolist() == enc.encode_ordinary(text + " then " + text)
    for n in (1_000_000, 5_000_000):
        text = left + space * (n // len(space)) + right
        ids = encode(enc, text).tolist()
        assert enc.decode_bytes(ids) == text.encode()
    # a run is one piece but for its last character
    a, b = (encode(enc, left + space * (k // len(space)) + right).tolist() for k in (40_000, 60_000))
    assert a[:5000] == b[:5000]
    assert a[-5:] == b[-5:]


def test_documents(spark, sf, enc):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in encode_texts(docs, RANKS, P.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"), part=500).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = enc.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "null id"), (3, "<|endoftext|>"), (3, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"tokens": F.lit("clash"), "n_tokens": F.lit(None)})
    out = encode_texts(docs, RANKS, P.PATTERN)
    got = [(r.doc_id, r.n_tokens) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (None, 2), (3, 7), (3, 7)], key=str)
    back = decode_tokens(out, RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes).decode()) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert encode_texts(docs.where("false"), RANKS, P.PATTERN).count() == 0
