"""Secret scan: fixed patterns, and a linear-chain conditional random field."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

#: The base patterns and how long what they find must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s]")
OUT, BEGIN, INSIDE = 0, 1, 2
#: Feature kinds: of the token, of the one before and after it, of the file.
#: Each kind has ``WIDTH`` weights of its own, addressed by hash.
OWN = ("bias", "shape", "size", "mix", "turns", "bits", "hex", "plain", "word")
SIDE = ("<word", "<shape", ">word", ">shape")
FILE = ("long", "marks")
WIDTH = 1024
BUCKETS = WIDTH * len(OWN + SIDE + FILE)
_AT = {k: i * WIDTH for i, k in enumerate(OWN + SIDE + FILE)}
KEEP = 1 << 18
#: Words longer than this are summed anew each time.
LONGEST = 64


def base_spans(text: str, longest: int = 1 << 62) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself); code points. ``longest``:
    length of the longest token, if known; hex runs lie inside tokens."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "key")):
        out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if longest >= 32:
        out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return out


def _slot(kind: str, value: str) -> int:
    return _AT[kind] + int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=4).digest(), "little") % WIDTH


def shape(word: str) -> str:
    """Of letters only: their case. Else classes of characters in order, runs
    collapsed: ``A`` ``a`` ``9``, other letters ``w``, the rest themselves; of
    more than 6 runs which classes there are, and how many runs (by doubling)."""
    if word.isalpha():
        return "lower" if word.islower() else "title" if word.istitle() else "upper" if word.isupper() else "mixed"
    s = re.sub(r"[^\W\dA-Za-z_]+", "w", re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"\d+", "9", word))))
    return s if len(s) <= 6 else "".join(sorted(set(s))) + "~" * (len(s) // 6).bit_length()


def size(word: str) -> str:
    n = len(word)
    return "0" if n < 4 else "4" if n < 8 else "8" if n < 16 else "16" if n < 24 else "24" if n < 32 else "32"


def _letters(form: str, length: str) -> list[int]:
    """The features, but the word itself, that a token of letters has."""
    return [_slot("bias", ""), _slot("shape", form), _slot("size", length), _slot("mix", "letters"), _slot("turns", "letters"), _slot("bits", "letters"), _slot("hex", "letters"), _slot("plain", f"letters{length}")]


def own_features(word: str) -> list[int]:
    name = _slot("word", word.lower())
    if word.isalpha():
        return [*_letters(shape(word), size(word)), name]
    n, length = len(word), size(word)
    mixed = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(word).values())
    hexed = n >= 8 and not word.strip("0123456789abcdef")
    plain = word.isascii() and word.replace("+", "").replace("/", "").replace("_", "").replace("-", "").isalnum()
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:], strict=False))
    return [_slot("bias", ""), _slot("shape", shape(word)), _slot("size", length), _slot("mix", f"{mixed}{plain}"), _slot("turns", str(turns.bit_length())), _slot("bits", f"{int(bits * 2)}"), _slot("hex", f"{hexed}{mixed}"), _slot("plain", f"{plain}{mixed}{length}"), name]


def side_features(word: str, side: str) -> list[int]:
    return [_slot(side + "word", word.lower()), _slot(side + "shape", shape(word))]


def file_features(words: list[str]) -> list[int]:
    """Of the whole text: its length, and its share of single marks."""
    marks = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    return [_slot("long", str(len(words).bit_length())), _slot("marks", str(int(10 * marks / max(1, len(words)))))]


class Crf:
    """Weights: emissions (BUCKETS x 3) and transitions (3 x 3). Inside never
    follows outside, and never starts a text."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move
        self.ready()

    def __getstate__(self):
        return self.emit, self.move

    def __setstate__(self, state):
        self.emit, self.move = state
        self.ready()

    def ready(self) -> None:
        e, m = self.emit, self.move
        self.own = _Sums(lambda w: e[own_features(w)].sum(0))
        self.prev = _Sums(lambda w: e[side_features(w, "<")].sum(0))
        self.next = _Sums(lambda w: e[side_features(w, ">")].sum(0))
        gain = np.maximum(e[:, 1], e[:, 2]) - e[:, 0]
        # What neighbours, file and transitions can add to a token's gain at most.
        most = sum(max(0.0, float(gain[_AT[k] : _AT[k] + WIDTH].max())) for k in SIDE + FILE)
        self.slack = most + 2 * max(0.0, float(np.max(m[np.isfinite(m)]) - m[0, 0]))
        word = max(0.0, float(gain[_AT["word"] : _AT["word"] + WIDTH].max()))
        forms = _Sums(lambda k: float(np.maximum(*(e[_letters(*k), s].sum() for s in (1, 2))) - e[_letters(*k), 0].sum()) + word + self.slack)

        def bound(w: str) -> float:
            if w.isalpha() and (b := forms[shape(w), size(w)]) <= 0:
                return b
            return float(max(self.own[w][1:]) - self.own[w][0]) + self.slack

        #: At least what a token adds to a path through it, over staying outside.
        self.bound = _Sums(bound)

    def emissions(self, words: list[str], lo: int, hi: int, file: np.ndarray) -> np.ndarray:
        own = np.array([self.own[w] for w in words[lo:hi]])
        prev = np.array([self.prev[words[t - 1] if t else ""] for t in range(lo, hi)])
        after = np.array([self.next[words[t + 1] if t + 1 < len(words) else ""] for t in range(lo, hi)])
        return own + prev + after + file

    def tag(self, words: list[str]) -> list[tuple[int, int]]:
        """[first, last] token runs of the best path.

        Exact: a token can only be tagged if it lies in a run whose summed
        bounds are positive; Viterbi runs over those stretches alone, and most
        texts have none.
        """
        bound = list(map(self.bound.__getitem__, words))
        if not bound or max(bound) <= 0:
            return []
        n = len(bound)
        ahead, run = [0.0] * n, 0.0
        for t, b in enumerate(bound):
            run = run + b if run > 0 else b
            ahead[t] = run
        run, spots = 0.0, []
        for t in range(n - 1, -1, -1):
            run = run + bound[t] if run > 0 else bound[t]
            if ahead[t] + run - bound[t] > 0:
                spots.append(t)
        spots.reverse()
        file = self.emit[file_features(words)].sum(0)
        out, i = [], 0
        while i < len(spots):
            j = i
            while j + 1 < len(spots) and spots[j + 1] == spots[j] + 1:
                j += 1
            lo, hi = spots[i], spots[j] + 1
            e = self.emissions(words, lo, hi, file)
            out += self._viterbi(e - e[:, :1], lo)
            i = j + 1
        return out

    def _viterbi(self, e: np.ndarray, at: int) -> list[tuple[int, int]]:
        m = self.move - self.move[0, 0]
        best, back = m[0] + e[0], []
        for t in range(1, len(e)):
            paths = best[:, None] + m
            back.append(paths.argmax(0))
            best = paths.max(0) + e[t]
        s = int((best + m[:, 0]).argmax())
        tags = [s]
        for b in reversed(back):
            s = int(b[s])
            tags.append(s)
        tags.reverse()
        out: list[tuple[int, int]] = []
        for t, s in enumerate(tags):
            if s == BEGIN:
                out.append((at + t, at + t))
            elif s == INSIDE and out:
                out[-1] = (out[-1][0], at + t)
        return out


class _Sums(dict):
    """Values by word (or by its form, the first of a key's parts), of which
    ``KEEP`` of at most ``LONGEST`` characters are kept: bounded in bytes."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, word):
        if len(self) > KEEP:
            self.clear()
        value = self.of(word)
        if len(word if isinstance(word, str) else word[0]) <= LONGEST:
            self[word] = value
        return value


def _shortened(word: str) -> str:
    return word if len(word) < 20 else word[: 16 + zlib.crc32(word.encode("utf-8", "replace")) % (len(word) - 16)]


def labelled_windows(text: str, reach: int = 12) -> list[tuple[np.ndarray, list[int]]]:
    """Training sequences of one text: features and tags of the tokens around
    each base secret; of a text without any, around its middle and around the
    first, middle and last long word (14 characters, 8 if not of letters only). Secrets
    also come a second time, without the features of neighbours and long ones
    shortened (to 16 characters or more, by hash), so that their own make-up
    counts by itself, whatever stands before them and how long they are."""
    found = list(TOKEN.finditer(text))
    words = [m.group() for m in found]
    if not words:
        return []
    tags = [OUT] * len(words)
    secrets = sorted((s, end) for _, _, end, s in base_spans(text))
    starts = [m.start() for m in found]
    at = np.searchsorted(starts, [s for s, _ in secrets], "left") if secrets else []
    centres = []
    for (s, end), t in zip(secrets, at, strict=True):
        t = int(t) - 1 if t and found[int(t) - 1].end() > s else int(t)
        first = t
        while t < len(found) and found[t].start() < end:
            if tags[t] == OUT:
                tags[t] = BEGIN if t == first else INSIDE
            t += 1
        centres.append(first)
    if not centres:
        odd = [t for t, w in enumerate(words) if len(w) >= 14 or len(w) >= 8 and not w.isalpha()]
        centres = sorted({len(words) // 2, *(odd[i] for i in (0, len(odd) // 2, -1) if odd)})
    file = file_features(words)
    out = []
    for c in centres:
        lo, hi = max(0, c - reach), min(len(words), c + reach)
        rows = [own_features(words[t]) + (side_features(words[t - 1], "<") if t else side_features("", "<")) + (side_features(words[t + 1], ">") if t + 1 < len(words) else side_features("", ">")) + file for t in range(lo, hi)]
        out.append((np.asarray(rows, np.int32), tags[lo:hi]))
        if any(tags[lo:hi]):
            alone = side_features("", "<") + side_features("", ">")
            bare = [own_features(_shortened(words[t])) + alone + file if tags[t] else r for t, r in zip(range(lo, hi), rows, strict=True)]
            out.append((np.asarray(bare, np.int32), tags[lo:hi]))
    return out


_NO = -1e9
#: What is added to a transition's weight: inside never follows outside.
_ALLOWED = np.array([[0, 0, _NO], [0, 0, 0], [0, 0, 0]])


class Sequences:
    """Sequences of one width: features ``x``, tags ``y``, which are ``live``."""

    def __init__(self, windows: list[tuple[np.ndarray, list[int]]]):
        n, length, k = len(windows), max(len(t) for _, t in windows), len(windows[0][0][0])
        self.x, self.y, self.live = np.zeros((n, length, k), np.int64), np.zeros((n, length), np.int64), np.zeros((n, length), bool)
        for i, (rows, tags) in enumerate(windows):
            self.x[i, : len(tags)], self.y[i, : len(tags)], self.live[i, : len(tags)] = rows, tags, True
        self.gold = np.eye(3)[self.y] * self.live[..., None]
        self.gold_move = np.zeros((3, 3))
        on = self.live[:, 1:]
        np.add.at(self.gold_move, (self.y[:, :-1][on], self.y[:, 1:][on]), 1)

    def likelihood(self, emit: np.ndarray, move: np.ndarray, decay: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean log likelihood of the tags less the decay term, and its gradient
        by both weights; forward-backward with a scale per step."""
        x, live = self.x, self.live
        n, length, k = x.shape
        e = sum(emit[x[:, :, j]] for j in range(k))
        top = e.max(2, keepdims=True)
        odds, m = np.exp(e - top), np.exp(move + _ALLOWED)
        odds[~live] = 1.0
        a, scale = np.empty((n, length, 3)), np.ones((n, length))
        now = odds[:, 0] * np.array([1.0, 1.0, 0.0])
        for t in range(length):
            if t:
                now = np.where(live[:, t, None], (a[:, t - 1] @ m) * odds[:, t], a[:, t - 1])
            scale[:, t] = now.sum(1)
            a[:, t] = now / scale[:, t, None]
        b, pair = np.ones((n, length, 3)), np.zeros((3, 3))
        for t in range(length - 2, -1, -1):
            on = live[:, t + 1]
            after = odds[:, t + 1] * b[:, t + 1] / scale[:, t + 1, None]
            pair += a[on, t].T @ after[on] * m
            b[:, t] = np.where(on[:, None], after @ m.T, b[:, t + 1])
        post = a * b * live[..., None]
        gold_path = (e * self.gold).sum() + (self.gold_move * move).sum()
        value = gold_path - (np.log(scale) + top[..., 0])[live].sum()
        diff = (self.gold - post).reshape(-1, 3)
        flat = x.reshape(-1, k)
        g = np.stack([sum(np.bincount(flat[:, j], diff[:, s], minlength=len(emit)) for j in range(k)) for s in range(3)], 1) / n - decay * emit
        h = (self.gold_move - pair) / n - decay * move
        return value / n - decay / 2 * ((emit * emit).sum() + (move * move).sum()), g, h


def train(windows: Iterable[tuple[np.ndarray, list[int]]], rounds: int = 60, decay: float = 1e-4, memory: int = 8) -> Crf:
    """Maximum likelihood (with decay) by L-BFGS, at most ``rounds`` steps."""
    windows = [w for w in windows if len(w[1])]
    emit, move = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    forbidden = _ALLOWED < 0
    if not any(any(t) for _, t in windows):
        emit[_slot("bias", ""), OUT] = 10.0  # nothing to learn from: nothing is added
        return Crf(emit, np.where(forbidden, -np.inf, move))
    data = Sequences(windows)

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, g, h = data.likelihood(w[: emit.size].reshape(emit.shape), w[emit.size :].reshape(3, 3), decay)
        return value, np.append(g.ravel(), h.ravel())

    w = np.zeros(emit.size + 9)
    value, g = at(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, alphas = g.copy(), []
        for ds, dg in reversed(past):
            alphas.append((ds @ way) / (ds @ dg))
            way -= alphas[-1] * dg
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, float(np.sqrt(g @ g)))
        for (ds, dg), alpha in zip(past, reversed(alphas), strict=True):
            way += (alpha - (dg @ way) / (ds @ dg)) * ds
        step, slope = 1.0, float(g @ way)
        if slope < 1e-9:
            break
        while step > 1e-6:
            new, ng = at(w + step * way)
            if new >= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        ds, dg = step * way, g - ng
        w, value, g = w + ds, new, ng
        if ds @ dg > 1e-12:
            past = [*past[-memory + 1 :], (ds, dg)]
    return Crf(w[: emit.size].reshape(emit.shape), np.where(forbidden, -np.inf, w[emit.size :].reshape(3, 3)))


def fit(docs: DataFrame, per_class: int = 800, most_windows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """A field trained on what the fixed patterns find.

    The bounds of the training sample: ``per_class`` different texts in which
    the patterns find something and as many others, the smallest by hash, of
    any length; of the windows cut from them in the executors at most
    ``most_windows``, the smallest by a hash of text and place. Copies of a text
    count once; null texts are ignored.

    Only a share of the hash range is looked at, which grows until it holds
    enough texts of both kinds (or all), so most rows are just hashed; hashes
    alone are compared, and the chosen texts are fetched by a second scan.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    place = F.pmod(F.col("hash"), F.lit(1 << 32))
    rough = r"(?i)AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
    with scratch(docs.sparkSession):
        share = min(1.0, 256 * per_class / max(1, docs.count()))
        while True:
            near = rows.where(place < int(share * (1 << 32)))
            seen = cut(near.select(F.col("text").rlike(rough).alias("hit"), "hash").distinct())
            counts = {r["hit"]: r["count"] for r in seen.groupBy("hit").count().collect()}
            if share == 1 or min(counts.get(k, 0) for k in (True, False)) >= per_class:
                break
            share = min(1.0, share * 16)
        first = lambda hit: seen.where(F.col("hit") == hit).orderBy(place, "hash").limit(per_class)
        some = first(True).unionByName(first(False)).select("hash")
        texts = cut(near.join(F.broadcast(some), "hash", "left_semi").groupBy("hash").agg(F.min("text").alias("text")).repartition(64, "hash"))

        def run(it):
            for b in it:
                for h, text in zip(b.column("hash").to_pylist(), b.column("text").to_pylist(), strict=True):
                    found = labelled_windows(text)
                    for i in range(0, len(found), 500):
                        part = found[i : i + 500]
                        yield pa.RecordBatch.from_arrays([pa.array([h] * len(part), pa.int64()), pa.array(range(i, i + len(part)), pa.int64()), pa.array([x.ravel() for x, _ in part], pa.list_(pa.int32())), pa.array([t for _, t in part], pa.list_(pa.int32()))], ["hash", "at", "x", "tags"])

        windows = cut(texts.mapInArrow(run, "hash bigint, at bigint, x array<int>, tags array<int>"))
        picked = windows.orderBy(F.xxhash64("hash", "at"), "hash", "at").limit(most_windows).select("x", "tags").toArrow()
    width = len(OWN + SIDE + FILE)
    return train((np.asarray(x, np.int32).reshape(-1, width), tags) for x, tags in zip(picked.column("x").to_pylist(), picked.column("tags").to_pylist(), strict=True))


def scan_text(field: Crf, text: str) -> list[tuple[str, int, int]]:
    """All spans: the base ones, and the field's that touch none of them."""
    words = TOKEN.findall(text)
    base = [(k, s, e) for k, s, e, _ in base_spans(text, max(map(len, words), default=0))]
    runs = field.tag(words)
    if runs:
        found = [m.span() for m in TOKEN.finditer(text)]
        for a, b in runs:
            s, e = found[a][0], found[b][1]
            if not any(s < y and x < e for _, x, y in base):
                base.append(("crf", s, e))
    return sorted(base, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, field: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` (array of kind, start, end in code points, end
    exclusive) of every whole text; no shuffle.

    A null text counts as empty; a null id stays null; repeated rows are scanned
    alike; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)  # a fixed table of weights
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    where = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(it):
        f = sent.value
        for b in it:
            col = b.column("text")
            out = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(f, col[i].as_py() or "")] for i in range(len(col))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, where)], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")
