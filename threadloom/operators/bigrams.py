"""M16 with any vocabulary: bigram emissions as a sparse table.

The cells p(token | concept, previous token) are rows of a partitioned table, of
those bigrams alone that meet a concept; they are joined to the positions that
need them, and expected counts are grouped sums. Nothing as wide as a vocabulary
is on the driver or in one task; what the driver holds is the chain, a small
matrix for each number of targets. ``Coded`` has sources as lists of ids: at most
``MOST`` cells go to the tasks, which then neither join nor shuffle positions; of
more cells the table is joined as above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.shared import release, stored

from . import chains

PAIR = "pair_index"
CELL = ["concept", "prev", "token"]
#: What stands before a first token, unlike any token.
START = ""
#: Cells that go to all tasks, and numbers that a task counts in an array.
MOST = 1 << 20


def bigram_cooccurrences(src: DataFrame, trg: DataFrame) -> DataFrame:
    """For each pair every (source position with its previous token, target
    position). Null tokens and concepts count as the empty text."""
    before = F.lag(F.coalesce("token", F.lit(START))).over(Window.partitionBy(PAIR).orderBy("pos"))
    s = src.select(PAIR, F.col("pos").alias("spos"), F.coalesce("token", F.lit(START)).alias("token"), F.coalesce(before, F.lit(START)).alias("prev"))
    return s.join(trg.select(PAIR, F.col("pos").alias("tpos"), F.coalesce("concept", F.lit("")).alias("concept")), PAIR)


def shares(counts: DataFrame) -> DataFrame:
    """Counts ``n`` of cells as shares ``p`` of their (concept, previous token).
    Counts are summed per cell first, so a frequent context has a row for each
    token that follows it, not for each of its positions."""
    c = counts.groupBy(*CELL).agg(F.sum("n").alias("n"))
    whole = c.groupBy("concept", "prev").agg(F.sum("n").alias("whole"))
    return c.join(whole, ["concept", "prev"]).select(*CELL, (F.col("n") / F.col("whole")).alias("p"))


def emissions(co: DataFrame, cells: DataFrame, floor: float = 1e-12) -> DataFrame:
    """``pair_index, pos, e``: each target's probability of each position's
    token; cells that the table lacks (bigrams not trained on) have ``floor``."""
    j = co.join(cells, CELL, "left")
    e = F.transform(F.array_sort(F.collect_list(F.struct("tpos", F.coalesce("p", F.lit(floor)).alias("p")))), lambda t: t["p"])
    return j.groupBy(PAIR, F.col("spos").alias("pos")).agg(e.alias("e"))


def expected(co: DataFrame, post: DataFrame) -> DataFrame:
    """Expected counts ``n`` of cells under state posteriors."""
    q = post.select(PAIR, F.col("pos").alias("spos"), F.col("state").alias("tpos"), F.col("post").alias("n"))
    return co.join(q, [PAIR, "spos", "tpos"]).groupBy(*CELL).agg(F.sum("n").alias("n"))


def train(co: DataFrame, chain: chains.Chain, rounds: int = 2, size: int = 4096) -> DataFrame:
    """The cells after ``rounds`` of expectation-maximisation under a given chain,
    from co-occurrence shares. ``co`` is read twice a round: pass it kept."""
    cells = stored(shares(co.withColumn("n", F.lit(1.0))))
    for _ in range(rounds):
        steps, made = stored(emissions(co, cells)), []
        post, _ = chains.posteriors(steps, chain, size, made)
        old, cells = cells, stored(shares(expected(co, post)))
        release(steps, old, *made)
    return cells


class Coded:
    """``pairs`` (``pair_index, x`` token ids, ``y`` concept ids): ids of tokens are 1
    to ``words``, 0 stands before a first token; ids of concepts are below ``kinds``.
    Cells are those of ``train``, with ids."""

    def __init__(self, pairs: DataFrame, kinds: int, words: int, chain: chains.Chain, size: int = 4096):
        self.base, self.kinds, self.chain, self.size = words + 1, kinds, chain, size
        token = F.col("x")
        before = F.concat(F.array(F.lit(0)), F.slice(token, 1, F.greatest(F.size(token) - 1, F.lit(0))))
        self.pairs = pairs.select(PAIR, F.zip_with(before, token, lambda p, t: p.cast("long") * self.base + t).alias("x"), "y")

    def _cells(self, counts: DataFrame) -> DataFrame:
        """Sums ``n`` by ``code`` as counts of cells."""
        pair = F.col("code") % self.base**2
        return counts.groupBy("code").agg(F.sum("n").alias("n")).select(F.floor(F.col("code") / self.base**2).alias("concept"), F.floor(pair / self.base).alias("prev"), (pair % self.base).alias("token"), "n")

    def rows(self) -> DataFrame:
        """``bigram_cooccurrences`` of ids."""
        x = self.pairs.select(PAIR, "y", F.posexplode("x").alias("spos", "x"))
        return x.select(PAIR, F.col("spos").cast("long").alias("spos"), F.floor(F.col("x") / self.base).alias("prev"), (F.col("x") % self.base).alias("token"), F.posexplode("y").alias("tpos", "concept")).withColumns({c: F.col(c).cast("long") for c in ("tpos", "concept")})

    def shares(self) -> DataFrame:
        """Co-occurrence shares."""
        width = self.base**2
        cells = width * self.kinds

        def run(it):
            total = np.zeros(cells if cells <= MOST else 0, np.int64)
            for b in it:
                for _, _, x, y in chains.ids(b):
                    code = (y.astype(np.int64) * width + x[:, None]).ravel()
                    if cells <= MOST:
                        total += np.bincount(code, minlength=cells)
                    else:
                        yield _batch(*np.unique(code, return_counts=True))
            yield _batch(np.flatnonzero(total), total[total > 0])

        return shares(self._cells(self.pairs.select("x", "y").mapInArrow(run, "code long, n double")))

    def sent(self, cells: DataFrame) -> tuple:
        """For all tasks: codes of the cells in order, their probabilities and, if
        ids allow few enough, the place of each code or -1; and how to find them."""
        t = cells.select((F.col("concept") * self.base**2 + F.col("prev") * self.base + F.col("token")).alias("code"), "p").toArrow()
        code, p = (t[c].to_numpy() for c in ("code", "p"))
        order, place, width = np.argsort(code), None, self.base**2
        code, p = code[order], p[order]
        if width * self.kinds <= MOST:
            place = np.full(width * self.kinds, -1, np.int32)
            place[code] = np.arange(len(code))
        sent = cells.sparkSession.sparkContext.broadcast((code, p, place))

        def find(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places by position and concept, and whether there is a cell."""
            code, _, place = sent.value
            wanted = y.astype(np.int64) * width + x[:, None]
            if place is not None:
                at = place[wanted]
                return at, at >= 0
            at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
            return at, code[at] == wanted

        return sent, find

    def sources(self, table: tuple, floor: float = 1e-12) -> chains.Sources:
        """Sources with ``emissions`` of what ``sent`` returned."""
        sent, find = table

        def emit(x, y):
            at, known = find(x, y)
            return np.where(known, sent.value[1][at], floor)

        return chains.emitting(self.pairs, emit, self.size)

    def expected(self, table: tuple) -> tuple[DataFrame, list[DataFrame]]:
        """``expected`` counts, and tables to ``release`` after their use."""
        sent, find = table

        def count(parts):
            codes, total = sent.value[0], 0.0
            for b, rows, post in parts:
                b = b.select(["x", "y"]).take(pa.array(rows))
                for _, _, x, y in chains.ids(b):  # these rows, all of one number of targets, in their order
                    at, known = find(x, y)
                    n = len(x)
                    total = total + np.bincount(at[known], post[:n][known], minlength=len(codes))
                    post = post[n:]
            if np.ndim(total):
                yield _batch(codes, total)

        counts, tables = chains.counted(self.sources(table), self.chain, count, "code long, n double", self.size)
        return self._cells(counts), tables

    def train(self, rounds: int = 2) -> DataFrame:
        """``train`` from ids."""
        cells = stored(self.shares())
        size = cells.count()
        if size > MOST:
            release(cells)
            co = stored(self.rows())
            out = train(co, self.chain, rounds, self.size)
            release(co)
            return out
        for _ in range(rounds if size else 0):
            table = self.sent(cells)
            counts, tables = self.expected(table)
            old, cells = cells, stored(shares(counts))
            release(old, *tables)
            table[0].destroy()
        return cells

    def likelihoods(self, cells: DataFrame) -> DataFrame:
        """K01 of every pair under ``cells``."""
        size = cells.count()
        if not size:
            return chains.likelihoods(emissions(self.rows(), cells), self.chain, self.size)
        if size > MOST:
            co = stored(self.rows())
            steps = stored(emissions(co, cells))
            release(co)
            return chains.likelihoods(steps, self.chain, self.size)
        return chains.likelihoods(self.sources(self.sent(cells)), self.chain, self.size)


def _batch(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.float64())], ["code", "n"])
