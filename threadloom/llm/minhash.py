"""Near-dedup: banded MinHash candidates, odd-sketch screening, exact links."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch
from .components import components, loose

U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text,
    A-Z lower-cased, split at ASCII white space; with fewer words the whole
    sequence is one shingle; without words there is none."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))
    w = min(width, len(words))
    n = len(words) - w + 1
    acc = np.full(n, w, U)
    for i in range(w):
        acc = _mix(acc * U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(acc)


@lru_cache
def most_flips(share: float, samples: int, bits: int, miss: float = 1e-9) -> int:
    """The population count that the XOR of two odd sketches passes with a chance
    below ``miss`` if each sample differs with the chance ``share``: exact, over
    both the number of samples that differ and how their flips (two each) fall
    into the ``bits``."""
    odd = np.arange(bits + 1)
    state, total = np.zeros(bits + 1), np.zeros(bits + 1)
    state[0], chance = 1.0, (1 - share) ** samples
    for d in range(samples + 1):
        total += chance * state
        chance *= (samples - d) / (d + 1) * share / (1 - share) if share < 1 else 0
        for _ in range(2):
            up, down = state * (bits - odd) / bits, state * odd / bits
            state = np.append(0, up[:-1]) + np.append(down[1:], 0)
    return int(np.flatnonzero(np.cumsum(total[::-1])[::-1] > miss).max(initial=0))


@dataclass(frozen=True)
class Plan:
    """Numbers that follow from the threshold.

    ``rows`` is the longest band for which a pair at the threshold is missed
    with a chance below 1e-8; ``flips`` is the population count that the odd
    sketches of such a pair pass with a chance below 1e-9."""

    threshold: int  # per cent
    width: int
    samples: int = 240
    bits: int = 1024
    forest: int = 128  # most members of a bucket in one spanning forest, on average
    block: int = 512  # and in one side of a comparison of all
    block_bytes: int = 32 << 20  # and most bytes of their full sets

    @property
    def rows(self) -> int:
        t, k = self.threshold / 100, self.samples
        return max([1, *(r for r in range(1, 40) if (1 - t**r) ** (k // r) <= 1e-8)])

    @property
    def flips(self) -> int:
        return most_flips(1 - self.threshold / 100, self.samples, self.bits)

    def multipliers(self) -> np.ndarray:
        return _mix(np.arange(1, self.samples + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)

    def signature(self, s: np.ndarray, mult: np.ndarray) -> np.ndarray:
        out = np.full(len(mult), np.iinfo(U).max, U)
        for i in range(0, len(s), 512):
            np.minimum(out, (s[i : i + 512, None] * mult).min(0), out=out)
        return out

    def bands(self, sig: np.ndarray) -> np.ndarray:
        b = self.samples // self.rows
        m = sig[: b * self.rows].reshape(b, self.rows)
        acc = np.arange(1, b + 1, dtype=U)
        for j in range(self.rows):
            acc = _mix(acc * U(0x9E3779B97F4A7C15) + m[:, j])
        return acc.view(np.int64)

    def odd_sketch(self, sig: np.ndarray) -> np.ndarray:
        """Each sample flips one bit; the parities as 64-bit words. The XOR of
        two sketches is the sketch of the samples that differ."""
        at = _mix(sig + np.arange(len(sig), dtype=U) * U(0xD6E8FEB86659FD93)) % U(self.bits)
        odd = np.bincount(at.astype(np.int64), minlength=self.bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _batches(it: Iterator[pa.RecordBatch], step) -> Iterator[pa.RecordBatch]:
    for batch in it:
        yield step(batch)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64()))


def _signed(plan: Plan):
    def run(it):
        mult, none = plan.multipliers(), np.empty(0, np.int64)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            n, h, bands = [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), plan.width)
                n.append(len(s))
                h.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(plan.bands(plan.signature(s, mult)) if len(s) else none)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h, pa.binary()), _lists(bands)], ["doc_id", "n", "h", "bands"])

        return _batches(it, step)

    return run


def _sets(plan: Plan):
    def run(it):
        mult = plan.multipliers()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            n, sets, odd = [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py(), plan.width)
                n.append(len(s))
                sets.append(s.tobytes())
                odd.append(plan.odd_sketch(plan.signature(s, mult)))
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), _lists(odd)], ["id", "n", "set", "odd"])

        return _batches(it, step)

    return run


def _verified(plan: Plan):
    """Exact links: 100 * |intersection| >= threshold * |union| on full sets."""

    def run(it):
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= plan.threshold * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            return pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

        return _batches(it, step)

    return run


def _groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The groups of a stream sorted by ``keys``; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None

    def unpack(t: pa.Table) -> dict[str, np.ndarray]:
        out = {}
        for c in t.column_names:
            col = t.column(c).combine_chunks()
            if pa.types.is_list(col.type):
                flat = col.flatten().to_numpy(zero_copy_only=False)
                out[c] = flat.reshape(len(col), -1).view(U) if len(col) else flat.reshape(0, 1).view(U)
            elif pa.types.is_binary(col.type):
                out[c] = np.array([*col.to_pylist(), None], object)[:-1]
            else:
                out[c] = col.to_numpy(zero_copy_only=False)
        return out

    for b in it:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[s].tolist())
            if key != last and held:
                yield unpack(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield unpack(pa.Table.from_batches(held))


def _flips(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Population counts of all XORs of two blocks of sketches."""
    out = np.empty((len(x), len(y)), np.int32)
    step = max(1, (1 << 20) // max(1, y.size))
    for i in range(0, len(x), step):
        out[i : i + step] = np.bitwise_count(x[i : i + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int32)
    return out


def _pairs(a: list, b: list) -> pa.RecordBatch:
    a, b = np.concatenate(a) if a else np.empty(0, np.int64), np.concatenate(b) if b else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _forests(plan: Plan):
    """For each block of a bucket the spanning forest of fewest flips."""

    def run(it):
        a, b, held = [], [], 0
        for g in _groups(it, ["bkey", "blk"]):
            ids, first = np.unique(g["id"], return_index=True)
            if len(ids) < 2:
                continue
            n, d = g["n"][first].astype(np.int64), _flips(g["odd"][first], g["odd"][first])
            small, large = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
            d[100 * small < plan.threshold * large] = 1 << 30
            np.fill_diagonal(d, 1 << 30)
            left = np.ones(len(ids), bool)
            best, via = np.full(len(ids), 1 << 30, np.int32), np.zeros(len(ids), np.int64)
            for _ in range(len(ids)):
                i = int(np.argmin(np.where(left, best, np.int32((1 << 30) + 1))))
                if best[i] <= plan.flips:
                    a.append(ids[[i]])
                    b.append(ids[[via[i]]])
                left[i] = False
                nearer = left & (d[i] < best)
                best[nearer], via[nearer] = d[i][nearer], i
            held += len(ids)
            if held > 20_000:
                yield _pairs(a, b)
                a, b, held = [], [], 0
        yield _pairs(a, b)

    return run


def _screen(plan: Plan, g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asking rows, other rows, which of their pairs may be links between
    different components) of one block pair."""
    q, r = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
    if not len(q) or not len(r):
        return q, r, np.zeros((len(q), len(r)), bool)
    n, label = g["n"].astype(np.int64), g["label"]
    ok = _flips(g["odd"][q], g["odd"][r]) <= plan.flips
    ok &= label[q][:, None] != label[r]
    ok &= 100 * np.minimum(n[q][:, None], n[r]) >= plan.threshold * np.maximum(n[q][:, None], n[r])
    return q, r, ok


def _involved(plan: Plan):
    """The members that have a screened partner; at most all that came in."""

    def run(it):
        for g in _groups(it, ["bkey", "i", "j"]):
            q, r, ok = _screen(plan, g)
            rows = np.concatenate([q[ok.any(1)], r[ok.any(0)]])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(g[c][rows]) for c in ("bkey", "i", "j", "side", "id", "label")], ["bkey", "i", "j", "side", "id", "label"])

    return run


def _common(x: list[np.ndarray], y: list[np.ndarray], ok: np.ndarray) -> np.ndarray:
    """Exact intersection sizes where ``ok``: pair by pair, or as products of
    membership matrices over a slice of the shared shingles at a time,
    whichever costs less."""
    out = np.zeros(ok.shape, np.int64)
    kinds, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    ends = np.cumsum([0, *map(len, x), *map(len, y)])
    width = 1 << 14
    if ok.sum() * 20_000 < ok.size * len(kinds) / 4:
        for i, j in zip(*np.nonzero(ok), strict=True):
            out[i, j] = len(x[i]) + len(y[j]) - len(np.union1d(x[i], y[j]))
        return out
    for lo in range(0, len(kinds), width):
        m = np.zeros((len(x) + len(y), min(width, len(kinds) - lo)), np.float32)
        for k in range(len(m)):
            own = at[ends[k] : ends[k + 1]] - lo
            m[k, own[(own >= 0) & (own < width)]] = 1
        out += np.rint(m[: len(x)] @ m[len(x) :].T).astype(np.int64)
    return out


def _linking(plan: Plan):
    """Exact links between different components inside a block pair; of several
    links that join the same components one is enough."""

    def run(it):
        for g in _groups(it, ["bkey", "i", "j"]):
            q, r, ok = _screen(plan, g)
            if not ok.any():
                continue
            sets = [np.frombuffer(s, U) for s in g["set"]]
            both = _common([sets[i] for i in q], [sets[i] for i in r], ok)
            n = g["n"].astype(np.int64)
            ok &= 100 * both >= plan.threshold * (n[q][:, None] + n[r] - both)
            top: dict[int, int] = {}

            def find(x: int, top=top) -> int:
                while top.setdefault(x, x) != x:
                    x = top[x]
                return x

            a, b = [], []
            for x, y in zip(*np.nonzero(ok), strict=True):
                u, v = find(int(g["label"][q[x]])), find(int(g["label"][r[y]]))
                if u != v:
                    top[max(u, v)] = min(u, v)
                    a.append(g["id"][q[x] : q[x] + 1])
                    b.append(g["id"][r[y] : r[y] + 1])
            if a:
                yield _pairs(a, b)

    return run


def _exploded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shingle: ``id, n, s``."""
    for b in it:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("set")]
        for i in range(0, len(sets), 64):
            part, sizes = sets[i : i + 64], [len(x) for x in sets[i : i + 64]]
            own = lambda c: pa.array(np.repeat(b.column(c).to_numpy(zero_copy_only=False)[i : i + 64], sizes), pa.int64())  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays([own("id"), own("n"), pa.array(np.concatenate(part), pa.int64())], ["id", "n", "s"])


def _prefixes(plan: Plan):
    """Of each id's shingles, sorted from the rarest on, as many that two sets at
    the threshold must share one of them."""

    def run(it):
        left, last = 0, None
        for b in it:
            ids, n = b.column("id").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)
            keep = np.zeros(len(ids), bool)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for s, e in zip(cuts, cuts[1:], strict=False):
                if ids[s] != last:
                    last, left = ids[s], int(n[s]) + 1 + (-plan.threshold * int(n[s])) // 100
                keep[s : min(e, s + left)] = True
                left = max(0, left - (e - s))
            yield b.filter(pa.array(keep))

    return run


def _by_rare_shingles(plan: Plan, crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """``bkey, id, label, n``: the members of ``crowd`` (``id, label``) grouped by
    the shingles of their prefixes (``_prefixes``, rarest within the crowd
    first). Two linked members share a group; what is merely common to many, as
    boilerplate, groups nobody. A row per shingle crosses the network."""
    each = crowd.join(sets.select("id", "n", "set").hint("merge"), "id").select("id", "n", "set").mapInArrow(_exploded, "id bigint, n bigint, s bigint")
    each = cut(each)
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select(loose(F.col("s")).alias("s"), "f")
    rare = each.join(often.hint("merge"), "s", "left").select("id", "n", "s", F.coalesce("f", F.lit(1)).alias("f"))
    picked = rare.repartition("id").sortWithinPartitions("id", "f", "s").mapInArrow(_prefixes(plan), "id bigint, n bigint, s bigint, f bigint")
    return picked.where("f > 1").select(F.col("s").alias("bkey"), "id", "n").join(crowd.hint("merge"), "id").select("bkey", "id", "label", "n")


def near_groups(docs: DataFrame, threshold: int = 85, width: int = 3, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Two documents are linked if the Jaccard similarity of their full shingle
    sets is at least ``threshold`` per cent; ``component_id`` is the smallest id
    reachable over links. Texts with equal sets collapse to one representative;
    banded MinHash proposes buckets, odd sketches (parity bitmaps of the MinHash
    samples) screen them, and only links confirmed on full sets count. A link is
    lost only if no band meets (a chance below 1e-8 at the threshold) or its
    sketches differ by more than ``Plan.flips`` (below 1e-9 there); both chances
    fall with the similarity, and there is no cap on buckets or partners.

    A bucket of two is its pair. A larger one first gives the spanning forest of
    its nearest sketches, block by block, so a large group of near copies costs
    a link per member; once those links are confirmed, only members outside the
    bucket's main component are compared with the others, again in blocks and on
    full sets inside the block's task, which hands on one link for each two
    components it joins. Where more than a block of members is outside (many
    texts alike but not linked, as by boilerplate), they are first grouped anew
    by their rarest shingles, of which linked texts must share one, so a crowd
    without links costs a row per shingle and no comparison.

    Nulls: a null or empty text has no shingles and no links; a null id takes
    part in no link (``component_id`` null, ``kept`` true). Repeated rows are
    one document; rows of one id with several texts share their links. Ids are
    cast to long: an id that is no number is an error (null without ANSI mode).
    """
    with scratch(docs.sparkSession) as keep:
        plan = Plan(threshold, width, **kw)
        ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
        sig = cut(ids.mapInArrow(_signed(plan), "doc_id bigint, n bigint, h binary, bands array<bigint>"))
        some = sig.where("n > 0 and doc_id is not null")
        classes = cut(some.groupBy("h").agg(F.min("doc_id").alias("rep")))
        reps = some.join(classes, (some["h"] == classes["h"]) & (some["doc_id"] == classes["rep"])).select("rep", "n", "bands")
        banded = reps.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("bkey"))
        buckets = (
            banded.groupBy("bkey")
            .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
            .where("lo < hi")
            .groupBy("lo", "hi", "n", "x", "y")  # buckets with the same members are one
            .agg(F.min("bkey").alias("bkey"))
        )
        buckets = cut(buckets.select("bkey", "lo", "hi", "n"))
        members = cut(banded.join(buckets.where("n > 2").select("bkey", F.col("n").alias("size")), "bkey").select("bkey", "id", "n", "size"))
        twos = buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
        wanted = twos.select(F.col("a").alias("id")).unionByName(twos.select(F.col("b").alias("id"))).unionByName(members.select("id")).distinct()
        sets = cut(ids.join(wanted.hint("merge"), ids["doc_id"] == wanted["id"], "left_semi").mapInArrow(_sets(plan), "id bigint, n bigint, set binary, odd array<bigint>").where("n > 0"))
        odd = sets.select("id", "n", "odd")

        two = lambda df, side: df.select(*[F.col(c).alias(f"{c}{side}") for c in df.columns])
        flips = F.aggregate(F.zip_with("odda", "oddb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        twos = twos.join(two(odd, "a"), F.col("a") == F.col("ida")).join(two(odd, "b"), F.col("b") == F.col("idb"))
        twos = twos.where((100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (flips <= plan.flips)).select("a", "b")

        blocks = F.ceil(F.col("size") / plan.forest).cast("int")
        # Two different divisions into blocks, so that parts of a large bucket meet.
        at = F.when(blocks <= 1, F.array(F.lit(0))).otherwise(F.array(F.pmod(F.xxhash64("id", F.lit(0)), blocks).cast("int"), (F.pmod(F.xxhash64("id", F.lit(1)), blocks) + blocks).cast("int")))
        # sketches are joined to a row a member, and dealt to blocks after that
        blocked = members.drop("n").join(odd, "id").select("bkey", "id", F.explode(at).alias("blk"), "n", "odd")
        tries = blocked.repartition("bkey", "blk").sortWithinPartitions("bkey", "blk").mapInArrow(_forests(plan), "a bigint, b bigint")
        tries = cut(tries.unionByName(twos).distinct())

        def confirmed(pairs: DataFrame) -> DataFrame:
            left = pairs.join(sets.select(loose(F.col("id")).alias("a"), F.col("set").alias("sa")), "a")
            full = left.join(sets.select(loose(F.col("id")).alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")
            return cut(full.mapInArrow(_verified(plan), "a bigint, b bigint").distinct())

        links = confirmed(tries)
        labels = cut(components(links))

        named = members.join(labels, members["id"] == labels["node"], "left").select("bkey", "id", F.coalesce("label", "id").alias("label"), "n")
        named = cut(named)

        def mixed(named: DataFrame) -> DataFrame:
            """Buckets of several components, their main one, and into how many blocks
            those outside it (``ni``) and all members (``nj``) are dealt."""
            tally = named.groupBy("bkey", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("items"))
            main = F.max_by("label", F.struct("rows", "label"))
            sums = tally.groupBy("bkey").agg(main.alias("main"), F.sum("rows").alias("all"), F.sum("items").alias("items"), F.max_by("items", F.struct("rows", "label")).alias("main_items"), F.max("rows").alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
            blocks = lambda rows, items: F.greatest(F.ceil(rows / plan.block), F.ceil(items * 8 / plan.block_bytes)).cast("int")
            return sums.select(loose(F.col("bkey")).alias("bkey"), "main", (F.col("all") - F.col("most")).alias("outside"), blocks(F.col("all") - F.col("most"), F.col("items") - F.col("main_items")).alias("ni"), blocks(F.col("all"), F.col("items")).alias("nj"))

        def joining(named: DataFrame, mixed: DataFrame) -> DataFrame:
            """Links between components from comparing those outside the main one with all."""
            within = named.drop("n").join(mixed, "bkey").join(odd, "id")
            i, j = F.pmod(F.xxhash64("id", F.lit(2)), F.col("ni")).cast("int"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("nj")).cast("int")
            cols = ["bkey", "id", "n", "label", "odd"]
            asks = within.where("label <> main").select(*cols, F.lit(0).alias("side"), i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"))
            rest = within.select(*cols, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), j.alias("j"))
            grouped = lambda df: df.repartition("bkey", "i", "j").sortWithinPartitions("bkey", "i", "j")
            open_rows = cut(grouped(asks.unionByName(rest)).mapInArrow(_involved(plan), "bkey bigint, i int, j int, side int, id bigint, label bigint"))
            return cut(grouped(open_rows.join(sets.hint("merge"), "id")).mapInArrow(_linking(plan), "a bigint, b bigint").distinct())

        parts = cut(mixed(named))
        more = joining(named, parts.where(F.col("outside") <= plan.block))
        crowded = parts.where(F.col("outside") > plan.block)
        if not crowded.isEmpty():
            crowd = cut(named.join(crowded.select("bkey"), "bkey", "left_semi").select("id", "label").distinct())
            rare = cut(_by_rare_shingles(plan, crowd, sets))
            more = more.unionByName(joining(rare, cut(mixed(rare)))).distinct()
        if not more.isEmpty():
            labels = components(links.unionByName(more))
        found = classes.join(labels, classes["rep"] == labels["node"], "left").select("h", F.coalesce("label", "rep").alias("component_id"))
        out = keep(sig).select("doc_id", "n", "h").join(keep(cut(found)), "h", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")))


def drop_near(docs: DataFrame, threshold: int = 80, width: int = 5, **kw) -> DataFrame:
    """``docs`` without the documents of a group that have not its smallest id."""
    losers = near_groups(docs, threshold, width, **kw).where("not kept").select(F.col("doc_id").alias("_loser")).distinct()
    return docs.join(losers.hint("merge"), docs[kw.get("id_col", "doc_id")] == losers["_loser"], "left_anti")
