"""Line dedup: counts of line hashes in levelled sorted runs, and the texts without frequent lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, lower_ascii, remove, scaled, scratch, shared_dir

#: ASCII white space, as ``trim`` takes it.
_BLANK = "\t\n\x0b\x0c\r "
_HASH = ["h1", "h2"]
#: Frequent lines up to this number (16 bytes each) go to every task as one
#: table; beyond it hits are found by a shuffle.
TABLE_LIMIT = 1 << 20


def _hashes(line: Column) -> tuple[Column, Column]:
    """128 bits of a lower-cased line's key: the line without white space at its ends."""
    key = F.btrim(line, F.lit(_BLANK))
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x9E3779B97F4A7C15 - (1 << 64)), key).alias("h2")


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_counts(docs: DataFrame, batches: int = 1, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """``batch, h1, h2, n``: in how many documents of a batch a line is found.

    Documents are dealt to batches by their ids, so all rows of an id meet in
    one batch and count as one document (rows without an id as one together).
    The first shuffle is by line and id, the second, of partial counts, by line:
    a line that a third of all documents share is a row per task in it.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.explode(_split(lower_ascii(F.col(text_col)))).alias("_line"))
    rows = rows.where(F.length(F.btrim("_line", F.lit(_BLANK))) >= min_chars)
    once = rows.select(F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int").alias("batch"), "_id", *_hashes(F.col("_line"))).distinct()
    return once.groupBy("batch", *_HASH).agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """Counts of line hashes as sorted runs in levels.

    ``add`` takes the counts of a new batch of documents, drops what the runs
    already know to be frequent (a merge anti-join with each run's settled
    lines), and writes the rest as a run of level 0. ``fanout`` runs of a level
    are compacted to one of the next: equal hashes' counts are added up. So a
    hash is rewritten once per level, and a batch meets at most ``fanout - 1``
    runs a level. Runs are tables bucketed and sorted by hash in the shared
    folder: merging them shuffles nothing but the new batch.

    Batches must hold different documents (``line_counts`` deals them so).
    """

    def __init__(self, spark: SparkSession, least: int = 10, fanout: int = 4, buckets: int = 16):
        if fanout < 2:
            raise ValueError("fanout below 2")
        self.spark, self.least, self.fanout, self.buckets = spark, least, fanout, buckets
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self._paths[name] = f"{shared_dir(self.spark)}/{name}"
        rows.repartition(self.buckets, *_HASH).write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", self._paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self._paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        rows = self.spark.table(names[0])
        for name in names[1:]:
            rows = rows.unionAll(self.spark.table(name))
        return rows.groupBy(*_HASH).agg(F.sum("n").alias("n"))

    def add(self, counts: DataFrame) -> None:
        """``counts``: ``h1, h2, n`` of a batch, a row per hash."""
        for name in [r for level in self.levels for r in level]:
            settled = self.spark.table(name).where(F.col("n") >= self.least)
            counts = counts.join(settled.select(*_HASH).hint("merge"), _HASH, "left_anti")
        run, level = self._write(counts.select(*_HASH, "n")), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            run = self._write(self._merged(old))
            for name in old:
                self._drop(name)
            level += 1

    def frequent(self) -> DataFrame:
        """``h1, h2`` of the lines found in ``least`` documents or more."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        return self._merged(runs).where(F.col("n") >= self.least).select(*_HASH)

    def close(self) -> None:
        for name in list(self._paths):
            self._drop(name)
        self.levels = []


def frequent_lines(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``h1, h2`` of the lines whose key has ``min_chars`` code points or more
    and is found in ``least`` documents or more: texts are read once, then the
    batches' counts go through ``LineRuns``. Written to the shared folder."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        counts = cut(line_counts(docs, batches, id_col, text_col, min_chars))
        runs = LineRuns(spark, least, fanout, scaled(counts.count(), 4_000_000, 8, 8192))
        try:
            for batch in range(batches):
                runs.add(counts.where(F.col("batch") == batch).drop("batch"))
            return keep(cut(runs.frequent()))
        finally:
            runs.close()


def _lookup(frequent: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row with a hash table: lists of hashes by the low bits of ``h1``, in
    pages of 1024 lists; made page by page, so no task reads more than a page
    or the list of pages."""
    size = max(1024, 1 << max(n - 1, 1).bit_length())
    at = F.col("h1").bitwiseAND(F.lit(size - 1))
    rows = frequent.select(at.alias("at"), F.struct(*_HASH).alias("item"))
    empty = frequent.sparkSession.range(size).select(F.col("id").alias("at"), F.lit(None).cast("struct<h1:bigint,h2:bigint>").alias("item"))
    lists = rows.unionAll(empty).groupBy("at").agg(F.collect_list("item").alias("items"))
    pages = lists.groupBy(F.shiftright("at", 10).alias("page")).agg(F.sort_array(F.collect_list(F.struct("at", "items"))).alias("l"))
    pages = pages.select("page", F.transform("l", lambda x: x["items"]).alias("lists"))
    return pages.agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "lists"))), lambda x: x["lists"]).alias("_table")), size


def drop_lines(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, table_limit: int = TABLE_LIMIT) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: every row's whole text without the
    ``frequent`` lines, the others joined by line feeds.

    Up to ``table_limit`` frequent lines (counted first; 16 MB at the default)
    travel to all tasks as one hash table, and texts are not shuffled. Beyond it
    the hits' positions are found by joins on the line and on the whole text,
    whose hot keys adaptive execution splits; results are equal.

    A null or empty text is one empty line; lines shorter than ``min_chars``
    after trimming always stay. Repeated rows are each returned; null ids stay
    null; other columns are ignored.
    """
    n = frequent.count()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keyed = F.transform(_split(lower_ascii(F.col("_text"))), lambda k: F.struct(*_hashes(k), F.length(F.btrim(k, F.lit(_BLANK))).alias("chars")))
    if n <= table_limit:
        table, size = _lookup(frequent, n)

        def known(k: Column) -> Column:
            at = k["h1"].bitwiseAND(F.lit(size - 1))
            items = F.get(F.get(F.col("_table"), F.shiftright(at, 10).cast("int")), at.bitwiseAND(F.lit(1023)).cast("int"))
            return (k["chars"] >= min_chars) & F.array_contains(items, F.struct(k["h1"].alias("h1"), k["h2"].alias("h2")))

        hits = F.transform(keyed, known)
        kept = let(hits, lambda hit: F.filter(_split(F.col("_text")), lambda x, i: ~F.get(hit, i)))
        out = rows.crossJoin(F.broadcast(table)).select("doc_id", "_text", kept.alias("_kept"))
    else:
        whole = [F.xxhash64("_text").alias("t1"), F.xxhash64(F.lit(1), "_text").alias("t2")]
        lines = rows.select(*whole, F.posexplode(keyed).alias("pos", "k")).select("t1", "t2", "pos", "k.*").where(F.col("chars") >= min_chars)
        found = lines.join(frequent.hint("merge"), _HASH).select("t1", "t2", "pos").distinct().groupBy("t1", "t2").agg(F.collect_list("pos").alias("_hits"))
        out = rows.withColumns({"t1": whole[0], "t2": whole[1]}).join(found.hint("merge"), ["t1", "t2"], "left")
        lines = _split(F.col("_text"))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("_hits", F.array().cast("array<int>")))
        out = out.select("doc_id", "_text", let(lines, lambda x: F.transform(stay, lambda i: F.get(x, i))).alias("_kept"))
    total = F.size(_split(F.col("_text"))).cast("long")
    return out.select("doc_id", total.alias("n_lines"), (total - F.size("_kept")).alias("n_dropped"), F.array_join("_kept", "\n").alias("kept"))


def line_dedup(docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``drop_lines`` with the ``frequent_lines`` of the same documents."""
    return drop_lines(docs, frequent_lines(docs, least, batches, fanout, min_chars, id_col, text_col), id_col, text_col, min_chars)
