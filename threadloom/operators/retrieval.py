"""Retrieval: n-best lists, ranks, sentence scores, similarity maps."""

from __future__ import annotations

from dataclasses import replace
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.numeric import dot
from threadloom.sources.shared import keep, stored

from .hmm import Params

PAIR = "pair_index"


def n_best(scores: DataFrame, n: int, query: str = "query_id", item: str = "item_id", score: str = "score") -> DataFrame:
    """The ``n`` best items of each query; equal scores: higher id first."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.desc(item))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def in_blocks(left: DataFrame, right: DataFrame, most_left: int = 16384, most_right: int = 65536, least: int = 64) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_lb`` and ``_rb``: a grid of blocks. Rows are dealt to
    blocks of their own side by hash, so that a task that runs again deals alike, and
    copied to each block of the other, so that in an equi-join on both no task
    holds more than about ``most_left`` and ``most_right`` rows however many
    there are. At least ``least`` blocks of the right side keep the cores busy."""
    a, b = -(-left.count() // most_left) or 1, max(least, -(-right.count() // most_right))
    deal = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return left.withColumn("_lb", deal(left, a)).withColumn("_rb", copies(b)), right.withColumn("_rb", deal(right, b)).withColumn("_lb", copies(a))


def score_all(queries: DataFrame, items: DataFrame, score: Column, blocks: int = 64) -> DataFrame:
    """Every query (a stated set) against every item, ``in_blocks``, of which
    there are ``blocks`` at least."""
    q, i = in_blocks(queries, items, least=blocks)
    return q.join(i, ["_lb", "_rb"]).drop("_lb", "_rb").withColumn("score", score)


def true_ranks(queries: DataFrame, items: DataFrame, score: Column, truth: Column, where: Column, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """Rank of the best-placed true item of each query among the items that
    ``where`` lets it meet, counted without sorting: one plus the items placed
    before it. Scores are made twice, in blocks: first for the best true item, a
    row a query, then to count what is ahead of it. Both sums combine inside the
    blocks' tasks; no score is written to a shuffle."""
    met = score_all(queries, items, score).where(where & truth)
    best = keep(met.groupBy(query).agg(F.max(F.struct("score", item)).alias("_b")))
    ahead = score_all(queries.join(best, query), items, score).where(where)
    return ahead.groupBy(query).agg((F.sum((F.struct("score", item) > F.col("_b")).cast("long")) + 1).alias("rank"))


def cosine(u: Column, v: Column) -> Column:
    return dot(u, v) / F.sqrt(dot(u, u) * dot(v, v))


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` rounded as Spark's ``round`` does: of its shortest decimal, halves
    away from zero. Only what lies next to a half is looked at as a decimal."""
    y = np.abs(x) * 10.0**digits
    low = np.floor(y)
    out = np.sign(x) * (low + (y - low >= 0.5)) / 10.0**digits
    for i in np.flatnonzero(np.abs(y - low - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class _Cosines:
    """Cosines of a block of queries and a block of items. Products of matrices,
    off by less than ``SLACK``, tell which pairs matter; those are summed up in
    the order of ``cosine``, so results are the same to the last bit. A row that
    has no vector scores below all."""

    SLACK, TILE, MOST = 1e-10, 1 << 22, 1 << 20

    def __init__(self, q: pa.Table, i: pa.Table, digits: int):
        self.digits = digits
        (self.q, self.qq, self.qn), (self.i, self.ii, self.itn) = self._rows(q.column("qv")), self._rows(i.column("iv"))
        self.qid, self.iid = (t.column(c).to_numpy() for t, c in ((q, "query_id"), (i, "item_id")))
        self.order = np.argsort(self.iid, kind="stable")

    @staticmethod
    def _rows(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        col = col.combine_chunks()
        flat, known = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), col.is_valid().to_numpy(zero_copy_only=False)
        v = np.full((len(col), len(flat) // max(1, known.sum())), np.nan)
        v[known] = flat.reshape(known.sum(), -1)
        square = np.zeros(len(v))
        for x in v.T:
            square = square + x * x
        with np.errstate(all="ignore"):
            return v, square, v / np.sqrt(square)[:, None]

    def tiles(self):
        """(first query, about the cosines of some queries with all items); -1 and
        less than any for a query's own id and for rows without a vector."""
        step = max(1, self.TILE // max(1, len(self.iid)))
        ids = self.iid[self.order]
        for at in range(0, len(self.qid), step):
            a = self.qn[at : at + step] @ self.itn.T
            a[np.isnan(a)] = -np.inf
            own = self.qid[at : at + step]
            for r, (x, y) in enumerate(zip(np.searchsorted(ids, own), np.searchsorted(ids, own, "right"), strict=True)):
                a[r, self.order[x:y]] = -np.inf
            yield at, a

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(r))
        for s in range(0, len(r), self.MOST):
            x, y = r[s : s + self.MOST], c[s : s + self.MOST]
            total = np.zeros(len(x))
            for d in range(self.q.shape[1]):
                total = total + self.q[x, d] * self.i[y, d]
            out[s : s + self.MOST] = half_up(total / np.sqrt(self.qq[x] * self.ii[y]), self.digits)
        return out

    def near(self) -> float:
        """Rounded scores may be equal, or in another order, up to this distance."""
        return 10.0**-self.digits + self.SLACK

    def best(self, n: int, where=None):
        """(query, item, score) row numbers of the ``n`` best, higher id first."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for at, a in self.tiles():
            if where is not None:
                a[~where(at, at + len(a))] = -np.inf
            if not a.size:
                continue
            cut = np.partition(a, -min(n, a.shape[1]), 1)[:, -min(n, a.shape[1])]
            r, c = np.nonzero((a >= cut[:, None] - self.near()) & np.isfinite(a))
            s = self.exact(r + at, c)
            o = np.lexsort((-self.iid[c], -s, r))
            r, c, s = r[o], c[o], s[o]
            top = np.arange(len(r)) - np.searchsorted(r, r) < n
            found.append((r[top] + at, c[top], s[top]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def ahead(self, score: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How many items come before each query's (score, item)."""
        n = np.zeros(len(self.qid), np.int64)
        for at, a in self.tiles():
            end = at + len(a)
            b = score[at:end, None]
            n[at:end] += (a > b + self.near()).sum(1)
            r, c = np.nonzero(np.abs(a - b) <= self.near())
            s, r = self.exact(r + at, c), r + at
            np.add.at(n, r, (s > score[r]) | ((s == score[r]) & (self.iid[c] > item[r])))
        return n


def _met(queries: DataFrame, items: DataFrame, run, schema: str, blocks: int) -> DataFrame:
    """``run`` on each pair of blocks (``in_blocks``)."""
    q, i = in_blocks(queries, items, least=blocks)
    return q.groupBy("_lb", "_rb").cogroup(i.groupBy("_lb", "_rb")).applyInArrow(run, schema)


def cosine_best(queries: DataFrame, items: DataFrame, n: int, digits: int = 6, blocks: int = 24) -> DataFrame:
    """``query_id, item_id, score, rank``: of all ``items`` (``item_id,
    iv``) but its own id the ``n`` of highest cosine to each of ``queries``
    (``query_id, qv``), rounded to ``digits``, equal scores by higher id first.
    All pairs are scored, by products of blocks; ids are longs, vectors of one
    length. What has no vector, or one of zeros, is not found."""

    def run(q: pa.Table, i: pa.Table) -> pa.Table:
        c = _Cosines(q, i, digits)
        x, y, s = c.best(n)
        return pa.table({"query_id": c.qid[x], "item_id": c.iid[y], "score": s})

    pairs = _met(queries.select("query_id", "qv"), items.select("item_id", "iv"), run, "query_id long, item_id long, score double", blocks)
    return n_best(pairs, n)


def cosine_ranks(queries: DataFrame, items: DataFrame, digits: int = 6, blocks: int = 24) -> DataFrame:
    """``true_ranks`` by cosine, as in ``cosine_best``; true items have the label of
    the query (``ql``, ``il``)."""

    def true(q: pa.Table, i: pa.Table) -> pa.Table:
        c = _Cosines(q, i, digits)
        ql, il = (t.column(k).to_numpy() for t, k in ((q, "ql"), (i, "il")))  # a null label is a NaN, equal to none
        x, y, s = c.best(1, lambda at, end: ql[at:end, None] == il)
        return pa.table({"query_id": c.qid[x], "item_id": c.iid[y], "score": s})

    def before(q: pa.Table, i: pa.Table) -> pa.Table:
        c = _Cosines(q, i, digits)
        return pa.table({"query_id": c.qid, "n": c.ahead(q.column("score").to_numpy(), q.column("item").to_numpy())})

    met = _met(queries.select("query_id", "qv", "ql"), items.select("item_id", "iv", "il"), true, "query_id long, item_id long, score double", blocks)
    best = keep(met.groupBy("query_id").agg(F.max(F.struct("score", F.col("item_id").alias("item"))).alias("_b")).select("query_id", "_b.*"))
    ahead = _met(queries.select("query_id", "qv").join(best, "query_id"), items.select("item_id", "iv"), before, "query_id long, n long", blocks)
    return ahead.groupBy("query_id").agg((F.sum("n") + 1).alias("rank"))


def translation_scores(src: DataFrame, kinds: DataFrame, params: DataFrame) -> DataFrame:
    """``pair_index, set_id, score`` of each source pair and target set
    (``kinds``: ``set_id, concepts``) that share a known token: the sum over
    source tokens of the log of the best translation probability; tokens outside
    the table are skipped. Whatever is not listed has no known token and scores
    -Infinity. Tokens are counted before the join."""
    best = kinds.select("set_id", F.explode("concepts").alias("concept")).join(params, "concept").groupBy("set_id", "token").agg(F.log(F.max("p")).alias("lp"))
    tokens = src.groupBy(PAIR, "token").agg(F.count(F.lit(1)).alias("n"))
    return tokens.join(best, "token").groupBy(PAIR, "set_id").agg(F.sum(F.col("n") * F.col("lp")).alias("score"))


def translation_search(src: DataFrame, trg: DataFrame, params: DataFrame, n: int, digits: int = 9) -> DataFrame:
    """``query_id, item_id, score, rank``: for each pair of ``src`` the ``n``
    best of all target pairs, by ``translation_scores`` rounded to ``digits``,
    equal scores by higher id first.

    Equal target sets are scored once. The best sets of a query are cut to ``n``
    before they cross the network (of a set only its ``n`` highest ids count),
    and a query with fewer scored sets is filled up with -Infinity from the
    highest ids, so nothing as large as all pairs squared is kept.
    """
    sets = trg.groupBy(PAIR).agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    kinds = sets.groupBy("concepts").agg(F.min(PAIR).alias("set_id"), F.max(PAIR).alias("top_id"))
    members = sets.join(kinds.select("concepts", "set_id"), "concepts").select("set_id", F.col(PAIR).alias("item_id"))
    members = members.withColumn("_k", F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("item_id")))).where(F.col("_k") <= n).drop("_k")
    scored = translation_scores(src, kinds.select("set_id", "concepts"), params).withColumn("score", F.round("score", digits))
    scored = n_best(scored.join(kinds.select("set_id", "top_id"), "set_id"), n, PAIR, "top_id")
    # Fewer than n sets are scored where this adds any: among the 2n sets of
    # highest ids at least n are not.
    spare = kinds.orderBy(F.desc("top_id")).limit(2 * n).select("set_id", F.lit(float("-inf")).alias("score"))
    short = src.select(PAIR).distinct().join(scored.where(F.col("rank") == n), PAIR, "left_anti")
    none = short.crossJoin(F.broadcast(spare)).join(scored.select(PAIR, "set_id"), [PAIR, "set_id"], "left_anti")
    every = scored.select(PAIR, "set_id", "score").unionByName(none.select(PAIR, "set_id", "score"))
    return n_best(every.join(members, "set_id").select(F.col(PAIR).alias("query_id"), "item_id", "score"), n)


def chain_scores(rows: DataFrame, p: Params, query: str = "query_id") -> DataFrame:
    """``rows`` (``query, set_id, x`` token ids, ``y`` concept ids) with
    ``score``: the log probability of the best alignment of ``x`` with ``y``
    under the chain and emissions of ``p``. Rows of equal shape are scored together."""
    sent = rows.sparkSession.sparkContext.broadcast(p)

    def run(it):
        for b in it:
            p = sent.value
            with np.errstate(divide="ignore"):
                obs = np.log(p.obs)
            xs, ys = b.column("x"), b.column("y")
            shape = np.stack([c.value_lengths().to_numpy(zero_copy_only=False) for c in (xs, ys)], 1)
            score = np.full(b.num_rows, -np.inf)
            for t, m in np.unique(shape, axis=0):
                at = np.flatnonzero((shape == (t, m)).all(1))
                if not t or not m:
                    continue
                init, trans = p.chain(int(m))
                x, y = (c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) for c in (xs, ys))
                e = obs[y[:, :, None], x[:, None, :]]  # rows x targets x positions
                with np.errstate(divide="ignore"):
                    s, move = np.log(init) + e[:, :, 0], np.log(trans)
                for k in range(1, t):
                    s = (s[:, :, None] + move).max(1) + e[:, :, k]
                score[at] = s.max(1)
            yield pa.RecordBatch.from_arrays([b.column(query), b.column("set_id"), pa.array(score)], [query, "set_id", "score"])

    kinds = dict(rows.dtypes)
    return rows.select(query, "set_id", "x", "y").mapInArrow(run, f"{query} {kinds[query]}, set_id {kinds['set_id']}, score double")


def chain_bounds(queries: DataFrame, sets: DataFrame, p: Params, floor: float) -> tuple[DataFrame, DataFrame]:
    """What no alignment scores above: (``query_id, set_id, bound`` of queries
    and sets that share a token above ``floor``, ``query_id, base``: the bound of
    all other sets). Every position takes its best concept, the chain its best
    start and moves."""
    spark, obs = queries.sparkSession, p.obs
    at = np.argwhere(obs > floor)
    known = spark.createDataFrame(pa.table({"concept": at[:, 0], "token": at[:, 1], "gain": np.log(obs[at[:, 0], at[:, 1]]) - np.log(floor)}))
    moves = F.create_map(*[F.lit(x) for m in p.init for x in (m, float(np.log(np.maximum(p.trans[m].max(), 1e-300))))])
    starts = F.create_map(*[F.lit(x) for m in p.init for x in (m, float(np.log(np.maximum(p.init[m].max(), 1e-300))))])
    best = sets.select("set_id", F.size("y").alias("m"), F.explode("y").alias("concept")).join(known, "concept").groupBy("set_id", "m", "token").agg(F.max("gain").alias("gain"))
    length = F.size("x")
    tokens = queries.select("query_id", length.alias("t"), F.explode("x").alias("token")).groupBy("query_id", "t", "token").agg(F.count(F.lit(1)).alias("n"))
    gain = tokens.join(best, "token").groupBy("query_id", "t", "set_id", "m").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    low = float(np.log(floor))
    base = queries.select("query_id", (length * low).alias("base"))
    start, move = (F.coalesce(c[F.col("m")], -F.log("m")) for c in (starts, moves))  # unknown sizes: uniform
    return gain.select("query_id", "set_id", (F.col("t") * low + F.col("gain") + start + (F.col("t") - 1) * move).alias("bound")), base


def chain_search(queries: DataFrame, items: DataFrame, p: Params, n: int, floor: float, digits: int = 6, blocks: int = 64) -> tuple[DataFrame, DataFrame]:
    """M31 by alignment: (``query_id, item_id, score, rank``; ``query_id, set_id,
    score`` of all that was scored exactly). ``queries``: ``query_id, x`` token
    ids; ``items``: ``item_id, y`` concept ids. Scores are log probabilities of
    the best alignment, rounded to ``digits``; equal scores: higher id first.
    Emissions at or below ``floor`` count as ``floor``.

    A threshold algorithm: the ``n`` sets of the highest bounds are scored, the
    lowest of these scores is the query's threshold, and only sets whose bound
    reaches it are scored further. Equal target sets are scored once. A query
    whose threshold doesn't exclude sets without a known token meets all of them,
    in blocks; every result is exact.
    """
    p = replace(p, obs=np.maximum(p.obs, floor))
    kinds = keep(items.groupBy("y").agg(F.min("item_id").alias("set_id"), F.max("item_id").alias("top_id")))
    members = items.join(kinds.select("y", "set_id"), "y").select("set_id", "item_id")
    members = members.withColumn("_k", F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("item_id")))).where(F.col("_k") <= n).drop("_k")
    queries = keep(queries.where(F.size("x") > 0))
    bounds, base = chain_bounds(queries, kinds, p, floor)
    whole = lambda rows: rows.join(queries, "query_id").join(kinds.select("set_id", "y"), "set_id")
    first = n_best(bounds, n, "query_id", "set_id", "bound").select("query_id", "set_id")
    scored = keep(chain_scores(whole(first), p))
    cut = scored.groupBy("query_id").agg(F.min("score").alias("cut"), F.count(F.lit(1)).alias("k")).withColumn("cut", F.when(F.col("k") >= n, F.col("cut") - 10.0**-digits))
    cut = keep(queries.select("query_id").join(cut, "query_id", "left").select("query_id", F.coalesce("cut", F.lit(float("-inf"))).alias("cut")))
    reach = bounds.join(cut, "query_id").where(F.col("bound") >= F.col("cut")).select("query_id", "set_id")
    open_queries = cut.join(base, "query_id").where(F.col("base") >= F.col("cut")).join(queries, "query_id").select("query_id")
    rest = score_all(open_queries, kinds.select("set_id"), F.lit(0.0), blocks).select("query_id", "set_id")
    more = reach.unionByName(rest).distinct().join(scored.select("query_id", "set_id"), ["query_id", "set_id"], "left_anti")
    scored = keep(scored.unionByName(chain_scores(whole(more), p)))
    rounded = scored.withColumn("score", F.round("score", digits)).join(kinds.select("set_id", "top_id"), "set_id")
    best = n_best(rounded, n, "query_id", "top_id").select("query_id", "set_id", "score")
    return n_best(best.join(members, "set_id").select("query_id", "item_id", "score"), n), scored


def match_maps(audio: DataFrame, image: DataFrame) -> DataFrame:
    """SISA, MISA and SIMA scores of each pair from frame and region
    vectors: mean over all, mean over time of the best region, mean over regions
    of the best time."""
    a = audio.select(PAIR, F.col("pos").alias("t"), F.col("vec").alias("a"))
    v = image.select(PAIR, F.col("pos").alias("r"), F.col("vec").alias("v"))
    m = a.join(v, PAIR).select(PAIR, "t", "r", dot(F.col("a"), F.col("v")).alias("s"))
    by_t = m.groupBy(PAIR, "t").agg(F.max("s").alias("x"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("n")).groupBy(PAIR).agg((F.sum("s") / F.sum("n")).alias("sisa"), F.avg("x").alias("misa"))
    by_r = m.groupBy(PAIR, "r").agg(F.max("s").alias("x")).groupBy(PAIR).agg(F.avg("x").alias("sima"))
    return by_t.join(by_r, PAIR)


def _places(c: pa.Array, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``vocab`` or -1) of all tokens of a list column."""
    rows = np.repeat(np.arange(len(c)), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return rows, pc.index_in(c.flatten(), value_set=vocab).fill_null(-1).to_numpy(zero_copy_only=False)


def _overlaps(l: pa.Array, r: pa.Array, vocab: pa.Array, chunk: int = 1024, width: int = 4096):
    """``_shared`` of two columns of lists of distinct tokens."""
    return _shared(len(l), *_places(l, vocab), len(r), *_places(r, vocab), len(vocab), chunk, width)


def _shared(left: int, lr: np.ndarray, lt: np.ndarray, right: int, rr: np.ndarray, rt: np.ndarray, tokens: int, chunk: int = 1024, width: int = 4096):
    """(first right row, intersection sizes of some right rows with all left ones)
    from (row, token) in order of rows: products of membership matrices for tokens
    that many left rows have, counts over posting lists for others."""
    often = np.bincount(lt, minlength=tokens)
    dense = np.flatnonzero(often * 16 >= left)
    column = np.full(tokens + 1, -1)
    column[dense] = np.arange(len(dense))
    order = np.argsort(lt, kind="stable")
    post, start = lr[order], np.concatenate([[0], np.cumsum(often)])

    def members(row: np.ndarray, tok: np.ndarray, n: int, c: int) -> np.ndarray:
        m, j = np.zeros((n, min(width, len(dense) - c)), np.float32), column[tok] - c
        inside = (j >= 0) & (j < m.shape[1])
        m[row[inside], j[inside]] = 1
        return m

    own = members(lr, lt, left, 0) if len(dense) <= width else None
    for at in range(0, right, chunk):
        lo, hi = np.searchsorted(rr, [at, at + chunk])
        row, tok = rr[lo:hi] - at, rt[lo:hi]
        n = min(chunk, right - at)
        rare = (tok >= 0) & (column[tok] < 0)
        x, t = row[rare], tok[rare]
        each = often[t]
        where = np.arange(each.sum()) + np.repeat(start[t] - np.cumsum(each) + each, each)
        both = np.bincount(np.repeat(x * left, each) + post[where], minlength=n * left).reshape(n, left)
        for c in range(0, len(dense), width):
            mine = own if own is not None else members(lr, lt, left, c)
            both += np.rint(members(row, tok, n, c) @ mine.T).astype(np.int64)
        yield at, both


class _Nearest:
    """Left rows of one key and, of all right rows seen, the one with the largest
    rounded similarity to each, ties to the lower id. Left rows are taken ``TILE``
    at a time."""

    TILE = 4096

    def __init__(self, ids: np.ndarray, tokens: pa.Array):
        self.ids, self.n = ids, tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = tokens.flatten().dictionary_encode()
        self.vocab, token = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(self.n)])
        self.tiles = []
        for at in range(0, len(ids), self.TILE):
            end = min(at + self.TILE, len(ids))
            self.tiles.append((at, end, np.repeat(np.arange(end - at), self.n[at:end]), token[ends[at] : ends[end]]))

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(len(self.ids)), np.zeros(len(self.ids), np.int64)

    def meet(self, sim: np.ndarray, best: np.ndarray, ids: np.ndarray, tokens: pa.Array) -> None:
        """Right rows ``ids``; ``sim`` and ``best`` (``start``) are brought up to date."""
        rows, n = _places(tokens, self.vocab), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi, row, token in self.tiles:
            for at, both in _shared(hi - lo, row, token, len(ids), *rows, len(self.vocab)):
                rid = ids[at : at + len(both)]
                s = np.where(rid[:, None] == self.ids[lo:hi], 0, both) / np.maximum(self.n[lo:hi] + n[at : at + len(both), None] - both, 1)
                x, y = np.nonzero((s > 0) & (s >= np.maximum(s.max(0), sim[lo:hi]) - 2e-9))
                s = half_up(s[x, y], 9)
                o = np.lexsort((rid[x], -s, y))
                first = o[np.unique(y[o], return_index=True)[1]]
                y, s, rid = y[first] + lo, s[first], rid[x[first]]
                more = (s > sim[y]) | ((s == sim[y]) & (s > 0) & (rid < best[y]))
                sim[y[more]], best[y[more]] = s[more], rid[more]


def jaccard_best(left: DataFrame, right: DataFrame, key: str, most_rows: int = 1 << 15, most_tokens: int = 1 << 23) -> DataFrame:
    """For each left row the right row of the same key with the largest
    Jaccard similarity of token sets; 0 is rejected, ties go to the lower id, a
    row never matches its own id. Ids are longs.

    Left rows, the stated queries, are dealt to as many parts by hash as keep a
    part to about ``most_rows`` rows and ``most_tokens`` tokens; one part at a time
    goes to all tasks and meets every right row where that is read. So the right
    side is neither shuffled nor copied (a table of fewer partitions than cores is
    shuffled once), and a task hands on one row for each left row. Inside a task
    sizes of intersections are products of matrices."""
    spark = right.sparkSession
    left = left.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "l_id", F.array_distinct("l_tokens").alias("l_tokens"))
    right = right.where(F.col(key).isNotNull())
    cores = spark.sparkContext.defaultParallelism
    if right.rdd.getNumPartitions() < cores:
        right = right.repartition(4 * cores, "r_id")
    right = right.select(F.col(key).alias("key"), "r_id", F.array_distinct("r_tokens").alias("r_tokens"))
    rows, tokens = left.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("l_tokens"), F.lit(0))), F.lit(0))).first()
    parts = max(1, -(-rows // most_rows), -(-tokens // most_tokens))

    def part(k: int) -> DataFrame:
        t = left.where(F.pmod(F.xxhash64("l_id"), F.lit(parts)) == k).toArrow().combine_chunks()
        of = {}
        for v in pc.unique(t["key"]).to_pylist():
            own = t.filter(pc.equal(t["key"], v)).combine_chunks()
            of[v] = _Nearest(own["l_id"].to_numpy(), own["l_tokens"].combine_chunks())
        sent = spark.sparkContext.broadcast(of)

        def run(it):
            found = {v: near.start() for v, near in sent.value.items()}
            for b in it:
                for v, near in sent.value.items():
                    own = b.filter(pc.equal(b.column("key"), v))
                    if own.num_rows:
                        near.meet(*found[v], own.column("r_id").to_numpy(), own.column("r_tokens"))
            for v, near in sent.value.items():
                sim, best = found[v]
                some = sim > 0
                yield pa.RecordBatch.from_arrays([pa.array(near.ids[some]), pa.array(best[some]), pa.array(sim[some])], ["l_id", "r_id", "sim"])

        met = right.mapInArrow(run, "l_id long, r_id long, sim double")
        out = stored(met.groupBy("l_id").agg(F.max_by("r_id", F.struct("sim", -F.col("r_id"))).alias("r_id"), F.max("sim").alias("sim")))
        sent.destroy()
        return out

    out = part(0)
    for k in range(1, parts):
        out = out.unionByName(part(k))
    return out


def occurrence_match(left: DataFrame, right: DataFrame, key: str = PAIR) -> DataFrame:
    """The n-th occurrence of a word on one side meets the n-th on the other."""
    w = lambda: Window.partitionBy(key, "token").orderBy("pos")
    a = left.select(key, "token", F.col("pos").alias("l_pos"), F.row_number().over(w()).alias("k"))
    b = right.select(key, "token", F.col("pos").alias("r_pos"), F.row_number().over(w()).alias("k"))
    return a.join(b, [key, "token", "k"]).select(key, "token", "l_pos", "r_pos")
