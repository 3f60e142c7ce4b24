"""W08, K01, K02, K05, K09 over sources of any length, by parallel prefix.

A source is cut into chunks of positions. A chunk's product of transition and
emission matrices is one m x m matrix: over (+, x) for sums, over (max, +) for best
paths. Products up to, and from, every chunk come from log2(chunks) meetings of a
chunk with the one 1, 2, 4, ... before it; a second pass inside each chunk starts
from what enters and leaves it.

Chunks are rows keyed (pair, chunk) that meet in joins (``steps``), or a row holds
some chunks next to each other (``Sources``): these meet in memory, those of
different rows in joins, and sources of one row need none. No row has more of a
source than one chunk or ``HELD`` positions. Rows with the same number of states
advance together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.shared import release, stored

from .hmm import lists, nested, picked

PAIR = "pair_index"
#: Chain of each number of states: first probabilities and moves.
Chain = dict[int, tuple[np.ndarray, np.ndarray]]
#: Best-path scores are whole numbers of 2^-32: sums are exact in any order, and
#: ties are ties. Impossible is far below any path.
UNIT = float(1 << 32)
NEVER = -(1 << 61)
#: Positions of a source that a row holds, if no chunk is longer; cells (positions
#: by states by states) that a kernel takes at once, one row at least.
HELD, MOST = 4096, 1 << 22


def whole_logs(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    return np.where(np.isfinite(logs), np.rint(np.where(np.isfinite(logs), logs, 0) * UNIT), NEVER).astype(np.int64)


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a + b, NEVER)  # two NEVERs still fit into 64 bits


def chunked(steps: DataFrame, size: int) -> DataFrame:
    """``pair_index, chunk, e``: emissions (states' probabilities) of up to
    ``size`` positions in order. ``steps``: ``pair_index, pos, e``, positions
    from 0 without gaps."""
    rows = steps.select(PAIR, F.floor(F.col("pos") / size).cast("long").alias("chunk"), "pos", "e")
    return rows.groupBy(PAIR, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda t: t["e"]).alias("e"))


def _matrices(column, dtype) -> Iterator[tuple[list[int], np.ndarray]]:
    """Rows of a list column by length, as (row numbers, stacked values)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
        yield at, values.reshape(len(at), -1)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places ``first`` to ``first + n`` of all rows, one after another."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def _groups(m: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers by number of states, for at most about ``MOST`` cells."""
    order = np.argsort(m, kind="stable")
    order = order[(m[order] > 0) & (n[order] > 0)]
    for rows in np.split(order, np.flatnonzero(np.diff(m[order])) + 1) if len(order) else ():
        part = np.cumsum(n[rows]) * int(m[rows[0]]) ** 2 // MOST
        yield from np.split(rows, np.flatnonzero(np.diff(part)) + 1)


def _given(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, lengths, emissions by position) of column ``e``."""
    steps = b.column("e").flatten()
    n = b.column("e").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    width, values = steps.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), steps.flatten().to_numpy(zero_copy_only=False)
    m = np.zeros(len(n), np.int64)
    m[n > 0] = width[(np.cumsum(n) - n)[n > 0]]
    first = np.cumsum(n * m) - n * m
    for rows in _groups(m, n):
        yield rows, n[rows], values[_spread(first[rows], n[rows] * m[rows])].reshape(-1, m[rows[0]])


class Sources:
    """Rows of ``held`` positions, ``pair_index, chunk`` (the row's number) and what
    ``read`` makes emissions of."""

    def __init__(self, rows: DataFrame, held: int, read: Callable = _given):
        self.rows, self.held, self.read = rows, held, read
        self.spark = rows.sparkSession
        self.key = rows.schema[PAIR].dataType.simpleString()
        self.last = rows.agg(F.max("chunk")).first()[0] or 0


def ids(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, lengths, tokens by position, concepts of the row by position)
    of columns ``x`` and ``y``."""
    (nx, fx, x), (ny, fy, y) = nested(b.column("x")), nested(b.column("y"))
    for rows in _groups(ny, nx):
        n = nx[rows]
        yield rows, n, x[_spread(fx[rows], n)], np.repeat(picked(fy[rows], ny[rows[0]], y), n, 0)


def emitting(pairs: DataFrame, emit: Callable, size: int) -> Sources:
    """``pairs`` (``pair_index, x`` token ids, ``y`` concept ids) whose states are
    the concepts, with emissions ``emit(tokens, concepts)`` by position."""
    held = max(size, HELD // size * size)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / held).cast("int")), lambda i: F.slice("x", i * held + 1, F.lit(held)))
    rows = pairs.where((F.size("x") > 0) & (F.size("y") > 0)).select(PAIR, "y", F.posexplode(parts).alias("chunk", "x"))

    def read(b):
        for rows, n, x, y in ids(b):
            yield rows, n, emit(x, y)

    return Sources(rows.select(PAIR, F.col("chunk").cast("long").alias("chunk"), "x", "y"), held, read)


def sources(pairs: DataFrame, obs: np.ndarray, size: int) -> Sources:
    """The same with emissions ``obs`` (concepts x tokens)."""
    sent = pairs.sparkSession.sparkContext.broadcast(obs)
    return emitting(pairs, lambda x, y: sent.value[y, x[:, None]], size)


def _cut(steps: DataFrame | Sources, size: int) -> tuple[Sources, list[DataFrame]]:
    """Sources, and the table written for them, if any."""
    if isinstance(steps, Sources):
        return steps, []
    chunks = stored(chunked(steps, size))
    return Sources(chunks, size), [chunks]


class Chunks:
    """Rows of ``n`` positions cut into chunks of ``size``: of each chunk its row,
    number from the row's start and end, first position and length."""

    def __init__(self, n: np.ndarray, size: int):
        k = -(-n // size)
        self.row, self.head = np.repeat(np.arange(len(n)), k), np.cumsum(k) - k
        self.tail = self.head + k - 1
        self.no = np.arange(len(self.row)) - self.head[self.row]
        self.after = k[self.row] - 1 - self.no
        self.at = (np.cumsum(n) - n)[self.row] + self.no * size
        length = np.minimum(size, n[self.row] - self.no * size)
        order = np.argsort(-length, kind="stable")
        #: The chunks that have a step t.
        self.steps = [order[:c] for c in np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")]

    def scan(self, p: np.ndarray, scale: np.ndarray, combine: Callable, forward: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """``scan`` inside rows."""
        p, scale, place, step = p.copy(), scale.copy(), self.no if forward else self.after, 1
        while step <= place.max(initial=0):
            i = np.flatnonzero(place >= step)
            j = i - step if forward else i + step
            made, more = combine(p[j], p[i]) if forward else combine(p[i], p[j])
            p[i], scale[i] = made, scale[i] + scale[j] + more
            step *= 2
        return p, scale


def _rows(b: pa.RecordBatch, names: list[str], **new) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *new.values()], [*names, *new])


def _sums(e: np.ndarray, c: Chunks, first: np.ndarray, init: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's matrix, divided by exp(scale), and scales. The rows of a source's
    first chunk are all the vector that its start gives, and one row where there are
    first chunks alone."""
    p, scale = (init[None, None] if first.all() else np.where(first[:, None, None], init, trans)) * e[c.at][:, None], np.zeros(len(c.at))
    for t, i in enumerate(c.steps[1:], 1):
        top = np.maximum(p[i].max((1, 2)), 1e-300)
        scale[i] += np.log(top)
        p[i] = (p[i] / top[:, None, None]) @ trans * e[c.at[i] + t][:, None]
    top = np.maximum(p.max((1, 2)), 1e-300)
    return p / top[:, None, None], scale + np.log(top)


def _bests(e: np.ndarray, c: Chunks, first: np.ndarray, init: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's best scores from entry to end state, and zeros; ``e`` are logs."""
    p = _plus(np.where(first[:, None, None], init, trans), e[c.at][:, None])
    for t, i in enumerate(c.steps[1:], 1):
        p[i] = _plus(_best(p[i], np.broadcast_to(trans, p[i].shape))[0], e[c.at[i] + t][:, None])
    return p, np.zeros(len(p))


def _products(s: Sources, chain: Chain, size: int, make: Callable, combine: Callable, log: Callable, kind: str) -> DataFrame:
    """``pair_index, chunk, p, scale``: each row's matrix."""
    sent, read = s.spark.sparkContext.broadcast({m: tuple(map(log, c)) for m, c in chain.items()}), s.read
    kind_pa = pa.float64() if kind == "double" else pa.int64()

    def run(it):
        for b in it:
            start = b.column("chunk").to_numpy() == 0
            for rows, n, e in read(b):
                c = Chunks(n, size)
                p, scale = c.scan(*make(log(e), c, start[rows][c.row] & (c.no == 0), *sent.value[e.shape[1]]), combine)
                p, scale = np.broadcast_to(p[c.tail], (len(rows), *[e.shape[1]] * 2)), scale[c.tail]
                yield _rows(b.select([PAIR, "chunk"]).take(pa.array(rows)), [PAIR, "chunk"], p=lists(np.full(len(p), p[0].size), p.ravel(), kind_pa), scale=pa.array(scale))

    return s.rows.mapInArrow(run, f"{PAIR} {s.key}, chunk long, p array<{kind}>, scale double")


def sum_products(s: Sources, chain: Chain, size: int) -> DataFrame:
    """Each row's sums over paths, divided by exp(scale)."""
    return _products(s, chain, size, _sums, _times, lambda x: x, "double")


def best_products(s: Sources, chain: Chain, size: int) -> DataFrame:
    """Each row's best scores from entry to end state."""
    return _products(s, chain, size, _bests, _best, whole_logs, "bigint")


def _times(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.matmul(a, b)
    top = np.maximum(p.max((1, 2)), 1e-300)
    return p / top[:, None, None], np.log(top)


def _best(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = a[:, :, 0, None] + b[:, 0, None]
    for k in range(1, a.shape[2]):
        np.maximum(out, a[:, :, k, None] + b[:, k, None], out)
    return np.maximum(out, NEVER), np.zeros(len(a))


def _follow(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composed maps: the state that ``a`` gives for the one that ``b`` gives."""
    return np.take_along_axis(a, b, 1), np.zeros(len(a))


def scan(rows: DataFrame, combine: Callable, dtype: type, forward: bool = True, square: bool = True) -> DataFrame:
    """``rows`` (``pair_index, chunk, p, scale``) with each ``p`` combined with
    all before it (or, backward, after it) of its pair, by doubling. Tables of
    earlier steps go as soon as the next is written; ``rows`` itself stays."""
    last = rows.agg(F.max("chunk")).first()[0] or 0
    kind = rows.schema["p"].dataType.simpleString()
    shape = f"{PAIR} {rows.schema[PAIR].dataType.simpleString()}, chunk long, p {kind}, scale double"
    kind_pa = pa.float64() if dtype is np.float64 else pa.int64()

    def run(it):
        for b in it:
            out, scale = [None] * b.num_rows, b.column("scale").to_numpy() + b.column("scale_2").to_numpy()
            other, met = b.column("p_2"), b.column("p_2").is_valid().to_numpy(zero_copy_only=False)
            for at, own in _matrices(b.column("p"), dtype):
                for k in np.flatnonzero(~met[at]):
                    out[at[k]] = own[k]
                k = np.flatnonzero(met[at])
                if not len(k):
                    continue
                mate = other.take(pa.array(at[k])).flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(k), -1)
                own = own[k]
                if square:
                    m = int(round(own.shape[1] ** 0.5))
                    own, mate = own.reshape(-1, m, m), mate.reshape(-1, m, m)
                made, more = combine(mate, own) if forward else combine(own, mate)
                made = made.reshape(len(k), -1)
                for i, r in enumerate(at[k]):
                    out[r], scale[r] = made[i], scale[r] + more[i]
            yield _rows(b, [PAIR, "chunk"], p=pa.array(out, pa.list_(kind_pa)), scale=pa.array(scale))

    step, given = 1, rows
    while step <= last:
        mate = rows.select(PAIR, (F.col("chunk") + (step if forward else -step)).alias("chunk"), F.col("p").alias("p_2"), F.col("scale").alias("scale_2"))
        joined = rows.join(mate, [PAIR, "chunk"], "left").withColumn("scale_2", F.coalesce("scale_2", F.lit(0.0)))
        old, rows = rows, stored(joined.mapInArrow(run, shape))
        if old is not given:
            release(old)
        step *= 2
    return rows


def _entered(s: Sources, before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Rows with ``enter`` (product up to the row before) and ``leave`` (product
    from the row after on), null at the ends."""
    rows = s.rows
    if before is not None:
        rows = rows.join(before.select(PAIR, (F.col("chunk") + 1).alias("chunk"), F.col("p").alias("enter")), [PAIR, "chunk"], "left")
    if after is not None:
        rows = rows.join(after.select(PAIR, (F.col("chunk") - 1).alias("chunk"), F.col("p").alias("leave")), [PAIR, "chunk"], "left")
    return rows


def _ends(before: DataFrame) -> DataFrame:
    width = F.sqrt(F.size("p")).cast("int")
    ends = before.select(PAIR, "chunk", (F.col("scale") + F.log(F.greatest(F.aggregate(F.slice("p", 1, width), F.lit(0.0), lambda x, y: x + y), F.lit(1e-300)))).alias("ll"))
    return ends.groupBy(PAIR).agg(F.max_by("ll", "chunk").alias("ll"))


def _beside(b: pa.RecordBatch, name: str, rows: np.ndarray, m: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(whether, matrix) of what the rows have of ``enter`` or ``leave``."""
    some, out = np.zeros(len(rows), bool), np.zeros((len(rows), m, m), dtype)
    if name in b.schema.names:
        col = b.column(name).take(pa.array(rows))
        some = col.is_valid().to_numpy(zero_copy_only=False)
        out[some] = col.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, m, m)
    return some, out


def _share(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(v.sum(-1, keepdims=True), 1e-300)


def _inside(e: np.ndarray, c: Chunks, first: np.ndarray, init: np.ndarray, trans: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Posteriors by position. ``enter`` and ``leave``: of each row what comes in (any
    for first rows) and what goes on, as vectors."""
    v, w = enter[c.row], leave[c.row]
    if c.no.max(initial=0):
        p = _sums(e, c, first, init, trans)
        i = np.flatnonzero(c.no)
        up = c.scan(*p, _times)[0][i - 1]
        begun = first[c.head][c.row[i]]
        v[i] = _share(np.where(begun[:, None], up[:, 0], (v[i][:, None] @ up)[:, 0]))
        i = np.flatnonzero(c.after)
        w[i] = (c.scan(*p, _times, forward=False)[0][i + 1] @ w[i][:, :, None])[:, :, 0]
    a = np.empty_like(e)
    v = np.where(first[:, None], init, v @ trans)
    for t, i in enumerate(c.steps):
        v[i] = _share((v[i] if t == 0 else v[i] @ trans) * e[c.at[i] + t])
        a[c.at[i] + t] = v[i]
    for t, i in reversed([*enumerate(c.steps)]):
        x = w[i] / np.maximum(w[i].max(1, keepdims=True), 1e-300)
        a[c.at[i] + t] *= x
        w[i] = (e[c.at[i] + t] * x) @ trans.T
    return _share(a)


def likelihoods(steps: DataFrame | Sources, chain: Chain, size: int = 4096) -> DataFrame:
    """K01 of ``posteriors`` alone: no backward products, no chunks are kept."""
    s, made = _cut(steps, size)
    if not s.last and not made:  # a row is a source
        sent, read = s.spark.sparkContext.broadcast(chain), s.read

        def run(it):
            for b in it:
                for rows, n, e in read(b):
                    c = Chunks(n, size)
                    p, scale = c.scan(*_sums(e, c, c.no == 0, *sent.value[e.shape[1]]), _times)
                    ll = scale[c.tail] + np.log(np.maximum(p[c.tail, 0].sum(1), 1e-300))
                    yield pa.RecordBatch.from_arrays([b.column(PAIR).take(pa.array(rows)), pa.array(ll)], [PAIR, "ll"])

        return s.rows.mapInArrow(run, f"{PAIR} {s.key}, ll double")
    products = stored(sum_products(s, chain, size))
    release(*made)
    before = scan(products, _times, np.float64)
    if before is not products:
        release(products)
    return _ends(before)


def _passes(s: Sources, chain: Chain, size: int) -> tuple[DataFrame, DataFrame, list[DataFrame], Callable]:
    """Rows with what enters and leaves; products up to each row; tables written; and
    of a batch of the rows (row numbers, lengths, first positions, posteriors by
    position)."""
    sent, read, held = s.spark.sparkContext.broadcast(chain), s.read, s.held
    products, after, tables = sum_products(s, chain, size), None, []
    if s.last:
        own = stored(products)
        products, after = scan(own, _times, np.float64), scan(own, _times, np.float64, forward=False)
        release(own)
        tables = [products, after]

    def run(b):
        number = b.column("chunk").to_numpy()
        for rows, n, e in read(b):
            m = e.shape[1]
            init, trans = sent.value[m]
            enter, (some, leave) = _beside(b, "enter", rows, m, np.float64)[1][:, 0], _beside(b, "leave", rows, m, np.float64)
            leave = np.where(some[:, None], leave.sum(2), 1.0)
            c = Chunks(n, size)
            yield rows, n, number[rows] * held, _inside(e, c, (number[rows] == 0)[c.row] & (c.no == 0), init, trans, enter, leave)

    return _entered(s, products if s.last else None, after), products, tables, run


def counted(s: Sources, chain: Chain, count: Callable, schema: str, size: int = 4096) -> tuple[DataFrame, list[DataFrame]]:
    """What ``count`` yields of each partition of (batch, row numbers, posteriors of
    these rows by position), and tables to ``release`` once it is used up."""
    rows, _, tables, kernel = _passes(s, chain, size)
    return rows.mapInArrow(lambda it: count((b, at, post) for b in it for at, _, _, post in kernel(b)), schema), tables


def posteriors(steps: DataFrame | Sources, chain: Chain, size: int = 4096, made: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(K05: ``pair_index, pos, state, post``; K01: ``pair_index, ll``) of
    ``steps`` (``pair_index, pos, e``) by chunks of ``size`` positions, or of
    ``Sources``. Tables that both read are appended to ``made``, for ``release``
    once both are used up.

    A source whose every path is impossible has posteriors of 0 and a
    log-likelihood near -690 or lower."""
    s, tables = _cut(steps, size)
    rows, before, more, kernel = _passes(s, chain, size)
    if made is not None:
        made += tables + more

    def run(it):
        for b in it:
            for rows, n, first, post in kernel(b):
                m = post.shape[1]
                at = np.repeat(rows, n * m)
                pos = np.repeat(_spread(first, n), m)
                yield pa.RecordBatch.from_arrays([b.column(PAIR).take(pa.array(at)), pa.array(pos), pa.array(np.tile(np.arange(m), len(post))), pa.array(post.ravel())], [PAIR, "pos", "state", "post"])

    return rows.mapInArrow(run, f"{PAIR} {s.key}, pos long, state long, post double"), _ends(before)


def _walk(e: np.ndarray, c: Chunks, first: np.ndarray, init: np.ndarray, trans: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk the scores at its end and the map from its end states to those of
    the chunk before (0 in a source's first), and of each position the back pointers."""
    v, back = enter[c.row], np.zeros(e.shape, np.int64)
    if c.no.max(initial=0):
        i = np.flatnonzero(c.no)
        up = c.scan(*_bests(e, c, first, init, trans), _best)[0][i - 1]
        v[i] = np.where(first[c.head][c.row[i]][:, None], up[:, 0], _best(v[i][:, None], up)[0][:, 0])
    for t, i in enumerate(c.steps):
        if t == 0:
            i = np.flatnonzero(~first)
        x = _plus(v[i][:, :, None], trans)
        back[c.at[i] + t] = x.argmax(1)
        x = x.max(1)
        if t == 0:
            start = np.where(first[:, None], init, 0)
            start[i] = x
            v = _plus(start, e[c.at])
        else:
            v[i] = _plus(x, e[c.at[i] + t])
    door = np.broadcast_to(np.arange(e.shape[1]), v.shape).copy()
    for t, i in reversed([*enumerate(c.steps)]):
        door[i] = np.take_along_axis(back[c.at[i] + t], door[i], 1)
    return v, door, back


def best_paths(steps: DataFrame | Sources, chain: Chain, size: int = 4096) -> DataFrame:
    """``pair_index, pos, state`` of the best path, ties to the lower state
    from the end backward. Scores are whole, so chunks of any size agree.

    Two scans: best scores into every chunk, then the maps from a chunk's end
    state to that of the chunk before, composed from the end."""
    s, plain = _cut(steps, size)
    rows, read, held, key = s.rows, s.read, s.held, s.key
    if s.last:
        products = stored(best_products(s, chain, size))
        before = scan(products, _best, np.int64)
        rows = stored(_entered(s, before, None))
        release(*plain, products, before)
    sent = s.spark.sparkContext.broadcast({m: tuple(map(whole_logs, c)) for m, c in chain.items()})

    def walked(b):
        start = b.column("chunk").to_numpy() == 0
        for rows, n, e in read(b):
            c, m = Chunks(n, size), e.shape[1]
            enter = _beside(b, "enter", rows, m, np.int64)[1][:, 0]
            yield rows, n, c, *_walk(whole_logs(e), c, start[rows][c.row] & (c.no == 0), *sent.value[m], enter)

    def doors(it):
        """For each end state of a row that of the row before, or a source's last
        state where the row is the last."""
        for b in it:
            for rows, _, c, score, door, _ in walked(b):
                p = c.scan(door, np.zeros(len(door)), _follow)[0][c.tail]
                yield _rows(b.select([PAIR, "chunk"]).take(pa.array(rows)), [PAIR, "chunk"], p=lists(np.full(len(p), p.shape[1]), p.ravel(), pa.int64()), scale=pa.array(np.zeros(len(p))), end=pa.array(score[c.tail].argmax(1)))

    if s.last:
        maps = stored(rows.mapInArrow(doors, f"{PAIR} {key}, chunk long, p array<long>, scale double, end long"))
        follow = scan(maps.drop("end"), _follow, np.int64, forward=False, square=False)
        last = maps.groupBy(PAIR).agg(F.max("chunk").alias("last"), F.max_by("end", "chunk").alias("end"))
        ends = follow.join(last, PAIR).select(PAIR, (F.col("chunk") - 1).alias("chunk"), F.get("p", F.col("end").cast("int")).alias("exit")).where(F.col("chunk") >= 0)
        ends = ends.unionByName(last.select(PAIR, F.col("last").alias("chunk"), F.col("end").alias("exit")))
        rows = rows.join(ends, [PAIR, "chunk"])

    def paths(it):
        for b in it:
            number = b.column("chunk").to_numpy()
            for rows, n, c, score, door, back in walked(b):
                at_end = b.column("exit").to_numpy()[rows] if "exit" in b.schema.names else score[c.tail].argmax(1)
                now, i = at_end[c.row], np.flatnonzero(c.after)
                follow = c.scan(door, np.zeros(len(door)), _follow, forward=False)[0]
                now[i] = follow[i + 1, now[i]]
                state = np.empty(len(back), np.int64)
                for t, i in reversed([*enumerate(c.steps)]):
                    state[c.at[i] + t] = now[i]
                    now[i] = back[c.at[i] + t, now[i]]
                yield pa.RecordBatch.from_arrays([b.column(PAIR).take(pa.array(np.repeat(rows, n))), pa.array(_spread(number[rows] * held, n)), pa.array(state)], [PAIR, "pos", "state"])

    return rows.mapInArrow(paths, f"{PAIR} {key}, pos long, state long")
