"""Cross-tokenizer alignment by elementary intervals of both token ends."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encode
from .common import cut, scratch

#: Pairs of ids whose corpus-wide counts go to every task, at most (17 bytes each).
TABLE_LIMIT = 1 << 19
#: Different pairs that a task counts before it hands its partial counts on.
_COUNTED = 1 << 21

#: Fixed value: the pre-splitting pattern of byte-level BPE files that name none.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1
    as itself, the other bytes in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Side A: the byte-level BPE of a tokenizers file.

    Where the file's merges make ids in their own order (so a rank is an id) and
    it neither normalises nor adds, tiktoken encodes by the file's vocabulary,
    four times as fast as the library that the file is for; else that library does.
    """

    def __init__(self, data: bytes):
        spec = json.loads(data)
        letters, model = byte_letters(), spec["model"]
        added = {t["content"] for t in spec.get("added_tokens") or []}
        self.bytes = [b""] * (max([*model["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])]) + 1)
        for t, i in model["vocab"].items():
            self.bytes[i] = t.encode() if t in added else bytes(letters[c] for c in t)
        ranks = {b: i for i, b in enumerate(self.bytes) if b and b.decode("utf-8", "replace") not in added}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.enc = self.lib = None
        if plain and made == sorted(made) and not spec.get("normalizer") and not model.get("ignore_merges"):
            import tiktoken

            self.enc = tiktoken.Encoding("local", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_str(data.decode())
            self.lib.encode_special_tokens = True
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return self.enc.decode_bytes(ids) if self.enc is not None else b"".join(map(self.bytes.__getitem__, ids))

    def encode(self, text: str) -> np.ndarray:
        """Ids of space + text; special tokens' strings are plain text."""
        if self.enc is not None:
            return encode(self.enc, " " + text)
        return np.array(self.lib.encode(" " + text, add_special_tokens=False).ids, np.int32)


class Pieces:
    """Side B: a sentencepiece model (which adds the space itself)."""

    _BYTE = regex.compile(r"<0x([0-9A-F]{2})>")

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(m[1], 16)]) if (m := self._BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int32)


#: Tokenizers of this worker, by side and content of the file.
_LOADED: dict = {}


def load(side: type, data: bytes):
    key = (side, hashlib.sha256(data).digest())
    if key not in _LOADED:
        _LOADED[key] = side(data)
    return _LOADED[key]


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per elementary interval, in order: the A token and the B token that own
    it, and whether both end with it (which closes a group). Ends are ascending
    and the last ones equal; as no end lies inside an interval, every pair of
    tokens that overlap owns exactly one."""
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # union1d hashes first, which takes longer than merging two runs
    ends = ends[np.flatnonzero(np.diff(ends, append=-1))]
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, ends_a[a] == ends_b[b]


def group_products(a: np.ndarray, b: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token of one group, group by group."""
    last = np.flatnonzero(closed)
    first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
    a0, b0 = a[first], b[first]
    na, nb = a[last] - a0 + 1, b[last] - b0 + 1
    size = na * nb
    group = np.repeat(np.arange(len(last)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return a0[group] + k // nb[group], b0[group] + k % nb[group]


class Aligner:
    """Both sides, and what is derived of a text's tokens."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.shift = 2 * len(a.bytes)
        names = lambda n, end: [s for i in range(n) for s in (f"{i},", f"{i}{end}")]
        self.names = names(len(a.bytes), "|") + names(len(b.bytes), ";")

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None where a side's bytes aren't those of space + text."""
        if not text:
            return None
        ids_a, ids_b = self.a.encode(text), self.b.encode(text)
        whole = b" " + text.encode()
        same = self.a.joined(ids_a.tolist()) == whole and self.b.joined(ids_b.tolist()) == whole
        return (ids_a, ids_b) if same else None

    def overlaps(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return intervals(np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b]))

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray, a: np.ndarray, b: np.ndarray, closed: np.ndarray) -> str:
        """The groups as text: ids of A, a bar, ids of B, groups set apart by semicolons."""
        end_a, end_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        end_a[a[closed]] = end_b[b[closed]] = 1
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[at_a] = 2 * ids_a.astype(np.int64) + end_a
        order[at_b] = self.shift + 2 * ids_b.astype(np.int64) + end_b
        return "".join(map(self.names.__getitem__, order.tolist()))[:-1]


def pair_keys(ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
    return (ids_a.astype(np.int64) << 32) | ids_b


class _Counts:
    """Counts of pairs within a task, handed on when many are different."""

    def __init__(self):
        self.open: list[np.ndarray] = []
        self.n, self.keys, self.counts = 0, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.open.append(keys)
        self.n += len(keys)
        if self.n > 1 << 20:
            self.fold()

    def fold(self) -> None:
        keys, counts = np.unique(np.concatenate([np.empty(0, np.int64), *self.open]), return_counts=True)
        both = np.concatenate([self.keys, keys])
        self.keys, at = np.unique(both, return_inverse=True)
        total = np.zeros(len(self.keys), np.int64)
        np.add.at(total, at, np.concatenate([self.counts, counts]))
        self.counts, self.open, self.n = total, [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        out = self.keys, self.counts
        self.__init__()
        return out


_DOC = ("doc_id", "_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids_a", "ids_b")
_DOC_TYPES = "_row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, ids_a binary, ids_b binary"


def _first_pass(file_a, file_b, id_type: pa.DataType, full: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, counts = Aligner(load(ByteLevel, file_a.value), load(Pieces, file_b.value)), _Counts()
        kinds = [id_type, *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary(), *([pa.string()] if full else []), pa.int64(), pa.int64()]
        names = [*_DOC, *(["groups"] if full else []), "pair", "n"]

        def batch(columns: list, rows: int):
            return pa.RecordBatch.from_arrays([pa.nulls(rows, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def counted():
            keys, n = counts.take()
            for i in range(0, len(keys), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield batch([None] * (len(kinds) - 2) + [keys[part], n[part]], len(keys[part]))

        for b in it:
            text, done = b.column("text"), 0
            out, held = [[] for _ in range(len(kinds) - 4)], 0
            for i in range(len(text)):
                ids = aligner.tokens((text[i].as_py() or b"").decode("utf-8", "replace"))
                row = [0, 0, 0, 0, "", b"", b"", ""]
                if ids is not None:
                    a, z, closed = aligner.overlaps(*ids)
                    groups = aligner.groups(*ids, a, z, closed)
                    counts.add(pair_keys(ids[0][a], ids[1][z]))
                    row = [len(ids[0]), len(ids[1]), int(closed.sum()), len(a), hashlib.sha256(groups.encode()).hexdigest(), ids[0].tobytes() if len(aligner.a.bytes) > 1 << 16 else ids[0].astype(np.uint16).tobytes(), ids[1].tobytes() if len(aligner.b.bytes) > 1 << 16 else ids[1].astype(np.uint16).tobytes(), groups]
                for c, v in zip(out, row):
                    c.append(v)
                held += len(row[5]) + len(row[6]) + (len(row[7]) if full else 0)
                if held > 1 << 23 or i + 1 == len(text):
                    n = i + 1 - done
                    yield batch([b.column("doc_id").slice(done, n), b.column("_row").slice(done, n), *out, None, None], n)
                    done, held, out = i + 1, 0, [[] for _ in out]
            if len(counts.keys) > _COUNTED:
                yield from counted()
        yield from counted()

    return run


def _second_pass(file_a, file_b, table):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.__new__(Aligner)
        aligner.a, aligner.b = load(ByteLevel, file_a.value), load(Pieces, file_b.value)
        keys, counts, best = table.value
        kind = lambda side: np.int32 if len(side.bytes) > 1 << 16 else np.uint16
        for b in it:
            rows, sums, bests, rest = b.column("_row").to_numpy(), [], [], []
            for i, (x, y) in enumerate(zip(b.column("ids_a"), b.column("ids_b"))):
                ids_a, ids_b = np.frombuffer(x.as_buffer(), kind(aligner.a)), np.frombuffer(y.as_buffer(), kind(aligner.b))
                a, z, _ = aligner.overlaps(ids_a, ids_b)
                pairs = pair_keys(ids_a[a], ids_b[z])
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                sums.append(int(counts[at[known]].sum()))
                bests.append(int(best[at[known]].sum()))
                if not known.all():
                    other, n = np.unique(pairs[~known], return_counts=True)
                    rest.append((np.full(len(other), rows[i]), other, n))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(sums, pa.int64()), pa.array(bests, pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], ["_row", "count_sum", "n_best", "pair", "n"])
            if rest:
                r, p, n = (np.concatenate(c) for c in zip(*rest))
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.int64()), pa.array(p, pa.int64()), pa.array(n, pa.int64())], ["_row", "count_sum", "n_best", "pair", "n"])

    return run


def align_texts(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False, table_limit: int = TABLE_LIMIT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    of every row's whole text, and ``groups`` (the text that is hashed) on demand.

    A is a byte-level BPE file (of space + text), B a sentencepiece model (of
    the text). Both files are read on the driver and broadcast; their size does
    not depend on the data. One pass encodes, aligns, and counts linked id pairs
    within each task; token ids are written to the shared folder. The counts are
    summed by pair; the highest of each B id is found among at most as many rows
    as B has ids. Then a pass over the written ids looks up each link's count:
    the most frequent pairs, ``table_limit`` at most by their counts' magnitude,
    go to every task as sorted arrays; links of rarer pairs are joined by
    pair, of which each holds few links.

    Null and empty texts, and those whose tokens' bytes differ from space +
    text, have zeros and '' and take no part in counts. Repeated rows count as
    often as they are there; null ids stay null; other columns are ignored.
    """
    spark = docs.sparkSession
    sides = []
    for name in (file_a, file_b):
        with open(name, "rb") as f:
            sides.append(spark.sparkContext.broadcast(f.read()))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    with scratch(spark) as keep:
        arrow_id = rows.limit(0).select("doc_id").toArrow().schema.field(0).type
        first = cut(rows.mapInArrow(_first_pass(*sides, arrow_id, groups), f"doc_id {id_type}, {_DOC_TYPES}, {'groups string, ' if groups else ''}pair bigint, n bigint"))
        texts, partial = first.where(F.col("_row").isNotNull()), first.where(F.col("pair").isNotNull())
        counts = partial.groupBy("pair").agg(F.sum("n").alias("count"))
        by_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
        counts = cut(counts)
        highest = counts.groupBy(by_b.alias("b")).agg(F.max("count").alias("highest"))
        counts = cut(counts.join(F.broadcast(highest), by_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best")))
        # magnitudes (powers of two) whose pairs fit into the table, from the highest down
        sizes = {r["m"]: r["count"] for r in counts.groupBy(F.floor(F.log2("count")).cast("int").alias("m")).count().collect()}
        least, held = 64, 0
        for m in sorted(sizes, reverse=True):
            held += sizes[m]
            if held > table_limit:
                break
            least = m
        common = F.floor(F.log2("count")).cast("int") >= least
        top = counts.where(common).orderBy("pair").toArrow()
        table = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "count", "best")))
        found = cut(texts.select("_row", "ids_a", "ids_b").where(F.length("ids_a") > 0).mapInArrow(_second_pass(*sides, table), "_row bigint, count_sum bigint, n_best bigint, pair bigint, n bigint"))
        rare = found.where(F.col("pair").isNotNull()).select("_row", "pair", "n").join(counts.where(~common).hint("merge"), "pair")
        rare = rare.select("_row", (F.col("n") * F.col("count")).alias("count_sum"), F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"))
        sums = found.where(F.col("pair").isNull()).select("_row", "count_sum", "n_best").unionAll(rare)
        sums = sums.groupBy("_row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
        shown = texts.select("doc_id", *_DOC[1:7], *(["groups"] if groups else []))
        out = shown.join(sums, "_row", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        return keep(cut(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *(["groups"] if groups else []))))
