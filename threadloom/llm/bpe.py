"""Byte-level BPE encoding and decoding with the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoders of this worker, by content of the rank file and pattern.
_ENCODERS: dict = {}

#: White space as the usual pre-splitting patterns' ``\s`` has it.
_SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0     　") | frozenset(map(chr, range(0x2000, 0x200B)))


#: The library's matcher gives up inside white space of about a million
#: characters; runs from this length on are matched here.
_LONG = 10_000
_RUN = regex.compile(r"\s{%d,}" % _LONG)


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def encoder(data: bytes, pattern: str):
    import tiktoken

    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(data), special_tokens={})
    return _ENCODERS[key]


def safe_parts(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut only where a white
    space character follows another character. The pattern's matches never run
    from a non-space into a space, and what looks ahead at a run of spaces looks
    at the run's end, which stays in its part; so no match spans a cut and the
    parts' matches are the text's. A stretch without such a place stays whole
    (a long run of white space inside it is for ``encode``).
    """
    start, n = 0, len(text)
    while n - start > size:
        at = start + size
        while at < n and not (text[at] in _SPACE and text[at - 1] not in _SPACE):
            at += 1
        yield text[start:at]
        start = at
    if start < n or not n:
        yield text[start:]


def _encode_part(enc, part: str) -> Iterator[list[int]]:
    """Tokens of a part. A long run of white space starts at a safe place and is
    matched with the same pattern by ``regex``, whose stack doesn't grow with
    the match; matches inside the run are encoded each as one piece. The match
    that leaves the run (its last character may belong to the next word) is
    where the library goes on. What follows the run is seen as context."""
    while len(part) >= _LONG and (run := _RUN.search(part)):
        a, b = run.span()
        if a:
            yield enc.encode_ordinary(part[:a])
            part, a, b = part[a:], 0, b - a
        at = a
        for m in regex.finditer(enc._pat_str, part, endpos=min(len(part), b + 64)):
            if m.end() > b or m.start() >= b:
                break
            yield enc._encode_single_piece(m.group().encode())
            at = m.end()
        if at == a:  # a pattern that takes the run and what follows as one
            break
        part = part[at:]
    if part:
        yield enc.encode_ordinary(part)


def encode(enc, text: str, size: int = 1 << 16) -> np.ndarray:
    """Token ids of the whole text, as int32."""
    parts = [np.asarray(t, np.int32) for p in safe_parts(text, size) for t in _encode_part(enc, p)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.int32), *parts])


def decode(enc, ids) -> bytes:
    """The raw bytes of a token sequence (not necessarily valid UTF-8)."""
    return enc.decode_bytes(ids.tolist() if hasattr(ids, "tolist") else ids)


def _mapped(data: bytes, pattern: str, fields: list[str], size: int, carry: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for b in it:
            col, count, tokens, digest, raw = b.column("text"), [], [], [], []
            for i in range(len(col)):
                ids = encode(enc, (col[i].as_py() or b"").decode("utf-8", "replace"), size)
                listed = ids.tolist()
                count.append(len(listed))
                if "tokens" in fields:
                    tokens.append(ids)
                if "ids_sha256" in fields:
                    digest.append(hashlib.sha256(" ".join([names[t] for t in listed]).encode()).hexdigest())
                if "decoded_sha256" in fields:
                    raw.append(hashlib.sha256(enc.decode_bytes(listed)).hexdigest())
            out = {"n_tokens": pa.array(count, pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int32())), "ids_sha256": pa.array(digest, pa.string()), "decoded_sha256": pa.array(raw, pa.string())}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[out[f] for f in fields], *[b.column(c) for c in carry]], ["doc_id", *fields, *carry])

    return run


_TYPES = {"n_tokens": "bigint", "tokens": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, fields: tuple[str, ...] = ("tokens", "n_tokens"), id_col: str = "doc_id", text_col: str = "text", part: int = 1 << 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and ``fields`` of every row's whole text, and its ``carry`` columns.

    ``rank_file`` is read once on the driver and broadcast (its size does not
    depend on the data); ``fields``: ``tokens, n_tokens, ids_sha256`` (decimal
    ids joined by one space), ``decoded_sha256`` (of the bytes that the ids
    decode to). Texts over ``part`` characters are encoded in parts cut at safe
    boundaries, white space of any length included. No shuffle; a task holds one
    Arrow batch.

    Nulls: a null text counts as empty, with no tokens; a null id stays null.
    Invalid UTF-8 is read with replacement characters. Repeated rows are encoded
    alike; other columns are ignored.
    """
    with open(rank_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *carry)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", *carry)}
    return rows.mapInArrow(_mapped(data, pattern, list(fields), part, list(carry)), f"doc_id {kinds['doc_id']}, " + ", ".join([f"{f} {_TYPES[f]}" for f in fields] + [f"{c} {kinds[c]}" for c in carry]))


def decode_tokens(rows: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """``doc_id, bytes``: the raw bytes of each row's ids; null ids give none."""
    with open(rank_file, "rb") as f:
        data = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(it):
        enc = encoder(data.value, pattern)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([enc.decode_bytes(x or []) for x in b.column("tokens").to_pylist()], pa.binary())], ["doc_id", "bytes"])

    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("tokens"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")
