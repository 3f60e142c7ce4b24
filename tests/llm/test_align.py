"""Cross-tokenizer alignment against a plain version with the files' own libraries."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.llm import align, queries

tokens = pytest.importorskip("public_tokenizers")
A, B = tokens.path("byte_bpe_50k.json"), tokens.path("piece_bpe_32k.model")


def plain(texts):
    """Rows of ``align_texts`` by comparing every pair of nearby tokens' byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = align.byte_letters()

    def ranges(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    docs = []
    for text in texts:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"?" for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        whole = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append(([], [], [], ""))
            continue
        ra, rb = ranges(bytes_a), ranges(bytes_b)
        links = [(i, j) for i, (s, e) in enumerate(ra) for j, (t, f) in enumerate(rb) if max(s, t) < min(e, f)] if len(ra) < 400 else None
        if links is None:
            links, j0 = [], 0
            for i, (s, e) in enumerate(ra):
                while rb[j0][1] <= s:
                    j0 += 1
                j = j0
                while j < len(rb) and rb[j][0] < e:
                    links.append((i, j))
                    j += 1
        shared = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, i, j = [], 0, 0
        for end in shared:
            x, y = [], []
            while i < len(ra) and ra[i][1] <= end:
                x.append(str(ids_a[i]))
                i += 1
            while j < len(rb) and rb[j][1] <= end:
                y.append(str(ids_b[j]))
                j += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        docs.append((ids_a, ids_b, [(ids_a[i], ids_b[j]) for i, j in links], ";".join(groups)))
    count = Counter(p for d in docs for p in d[2])
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(highest.get(y, 0), n)
    return [
        (len(x), len(y), g.count(";") + 1 if g else 0, len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for x, y, links, g in docs
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), plain([r.text for r in rows])))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_align(spark, sf).collect()}
    assert got == want
    assert any(v[4] < v[3] for v in want.values())


EDGE = [None, "", " ", "a", "\n\n x  y", "café 漢字 \U0001f600", "literal ▁ mark", "<|endoftext|> <s> <unk> <0x41>", "x" * 30_000, " " * 30_000 + "z", "ab " * 9000, "a\x00b", "é Å ﬁ", "a", "a"]


@pytest.mark.parametrize("limit", [0, 3, 1 << 19])
def test_edges(spark, limit):
    """Rare pairs by the join give what the table gives."""
    docs = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(EDGE)], "doc_id bigint, text string").withColumns({"_row": F.lit("x"), "pair": F.lit(1), "n": F.lit(1.5), "odd.name": F.lit(1)})
    got = align.align_texts(docs, A, B, groups=True, table_limit=limit).collect()
    assert {r.doc_id if r.doc_id is not None else 4: tuple(r[c] for c in COLUMNS) for r in got} == dict(enumerate(plain(EDGE)))
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 if r.groups else r.groups_sha256 == "" for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    out = align.align_texts(docs, A, B)
    assert out.count() == 0 and out.schema["doc_id"].dataType.simpleString() == "string"


def test_products():
    import numpy as np

    a, b, closed = align.intervals(np.array([2, 3, 7, 9]), np.array([3, 5, 6, 7, 9]))
    assert list(zip(a, b, closed)) == [(0, 0, False), (1, 0, True), (2, 1, False), (2, 2, False), (2, 3, True), (3, 4, True)]
    x, y = align.group_products(a, b, closed)
    assert list(zip(x, y)) == [(0, 0), (1, 0), (2, 1), (2, 2), (2, 3), (3, 4)]
    a, b, closed = align.intervals(np.array([2, 5]), np.array([3, 5]))
    assert list(zip(*align.group_products(a, b, closed))) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_counts_handed_on(monkeypatch, spark, sf):
    monkeypatch.setattr(align, "_COUNTED", 10)
    t = align._Counts()
    import numpy as np

    t.add(np.array([1, 1, 2]))
    t.fold()
    t.add(np.array([2, 3]))
    keys, n = t.take()
    assert dict(zip(keys.tolist(), n.tolist())) == {1: 2, 2: 2, 3: 1} and not len(t.take()[0])


def test_library_side(tmp_path):
    """A file that normalises is encoded by its own library."""
    import json

    spec = json.load(open(A))
    spec["normalizer"] = {"type": "Lowercase"}
    side = align.ByteLevel(json.dumps(spec).encode())
    assert side.enc is None
    fast = align.ByteLevel(open(A, "rb").read())
    assert fast.enc is not None
    assert side.encode("already low").tolist() == fast.encode("already low").tolist()
