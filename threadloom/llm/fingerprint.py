"""Threshold-scaled sketches: every shingle hash below a fixed fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, let, scaled


def _bound(scale: int) -> Column | None:
    """What kept hashes are below; None: every hash is kept."""
    return F.lit(-(1 << 63) + (1 << 64) // scale) if scale > 1 else None


def sketch(text: Column, width: int = 5, scale: int = 8) -> Column:
    """Sorted array<long> of the shingle hashes in the lowest 1/``scale`` of the
    64-bit range; shingles are ``width`` consecutive words (a shorter text is one
    shingle, a text without words has none). A text none of whose hashes is that
    low keeps its smallest one, so that short texts still compare; such a lone
    hash is known by lying above the bound. Sketches of parts merge (``merge``)
    to the sketch of all their shingles, and a huge and a tiny text compare by
    containment.
    """
    none = F.array().cast("array<bigint>")
    low = _bound(scale)

    def of_hashes(hashes: Column) -> Column:
        if low is None:
            return F.sort_array(F.array_distinct(hashes))
        kept = lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.array_min(hashes)))
        return F.sort_array(F.array_distinct(let(F.filter(hashes, lambda h: h < low), kept)))

    def of_words(words: Column) -> Column:
        last = F.greatest(F.size(words) - (width - 1), F.lit(1))
        hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, width)))
        return F.when(F.size(words) == 0, none).otherwise(let(hashes, of_hashes))

    return let(F.filter(F.split(text, SPACES), lambda w: w != ""), of_words)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches; two empty ones are alike (1)."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1.0)))


def merge(a: Column, b: Column, scale: int = 8) -> Column:
    """The sketch of the union of two shingle sets from their sketches: what is
    below the bound, or else the smaller of the two lone hashes."""
    low = _bound(scale)
    union = F.sort_array(F.array_union(a, b))
    if low is None:
        return union
    kept = F.filter(union, lambda h: h < low)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(union, 1, 1))


def containment(a: Column, b: Column, scale: int = 8) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, from the hashes below
    the bound alone, so the two may be of very unequal length; null where ``a``
    has none of them, as a lone hash says nothing of a longer text."""
    low = _bound(scale)
    kept = a if low is None else F.filter(a, lambda h: h < low)
    return let(kept, lambda k: F.size(F.array_intersect(k, b)) / F.nullif(F.size(k), F.lit(0)).cast("double"))


def as_string(s: Column) -> Column:
    return F.array_join(F.transform(s, F.hex), "")


def _cell(id_: Column, bounds: list, parts: int) -> Column:
    """A bucket number that never decreases with the id: between which of the
    ``bounds`` it lies, then which of ``parts`` equal steps between the two."""
    if not bounds:
        return F.lit(0).cast("long")
    edges = F.array(*[F.lit(b) for b in bounds])
    at = F.size(F.filter(edges, lambda b: b <= id_))
    lo = F.coalesce(F.try_element_at(edges, F.greatest(at, F.lit(1))), id_)
    hi = F.coalesce(F.try_element_at(edges, at + 1), lo)
    step = F.when((at > 0) & (hi > lo), F.floor((id_ - lo).cast("double") / (hi - lo).cast("double") * parts)).otherwise(F.lit(0))
    return F.coalesce(at.cast("long") * parts + F.least(step, F.lit(parts - 1)), F.lit(-1).cast("long"))


def with_next(rows: DataFrame, carry: list[str], id_col: str = "doc_id", tie: str = "_tie", per_bucket: int = 500, edges: int = 256, most: int = 1 << 18, derive: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``next_<c>`` for each carried column of the following row by
    ascending id (nulls first, then ``tie``); the last row is followed by the first.
    Columns to ``derive`` are added (and may be carried) once per row, after the
    rows to be sent are known.

    Ids are dealt into buckets that follow their order (quantile edges, then
    equal steps), each row looks ahead inside its bucket, and the first row of
    every bucket is also sent, as a mere successor, to the bucket before it. No
    task sorts the whole table; the bucket table has at most ``most`` rows. Rows
    without an id, or with one id, share a bucket and a task: ids are meant to
    name rows.
    """
    n = rows.count()
    buckets = scaled(n, per_bucket, 1, most)
    wanted = min(edges, buckets)
    ids = rows.select(F.col(id_col).alias("id"))
    bounds = ids.agg(F.percentile_approx("id", [i / wanted for i in range(wanted)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    parts = -(-buckets // max(1, len(bounds)))
    cell = lambda c: _cell(c, bounds, parts)
    heads = ids.select(cell(F.col("id")).alias("cell")).distinct()
    ring = heads.select("cell", F.lag("cell").over(Window.orderBy("cell")).alias("before"))
    ring = ring.crossJoin(F.broadcast(heads.agg(F.max("cell").alias("last"))))
    ring = ring.select("cell", F.coalesce("before", "last").alias("before"), (F.col("before").isNull()).alias("wraps"))
    rows = rows.withColumn("_cell", cell(F.col(id_col)))
    firsts = ids.select(cell(F.col("id")).alias("cell"), "id").groupBy("cell").agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("nulls"))
    firsts = firsts.join(ring, "cell").select("cell", "before", "wraps", F.when(F.col("nulls"), F.lit(None)).otherwise(F.col("first")).alias("first"))
    own = rows.withColumns({"_role": F.lit(0)})
    heads_only = rows.join(F.broadcast(firsts), (rows["_cell"] == firsts["cell"]) & rows[id_col].eqNullSafe(firsts["first"]))
    sent = heads_only.select(*rows.columns[:-1], F.col("before").alias("_cell"), F.when(F.col("wraps"), F.lit(2)).otherwise(F.lit(1)).alias("_role"))
    w = Window.partitionBy("_cell").orderBy("_role", F.col(id_col), F.col(tie))
    out = own.unionByName(sent)
    if derive:
        out = out.withColumns(derive)
    return out.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).where(F.col("_role") == 0).drop("_cell", "_role")


def fingerprints(docs: DataFrame, width: int = 5, scale: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, sketch`` of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("sketch", sketch(F.col("text"), width, scale))


def edit_probe(docs: DataFrame, width: int = 5, scale: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints against an edited text and against the next document.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document by ascending id; the last document is
    followed by the first, a single one by itself. Repeated ids are ordered by
    the text's hash; a null text counts as empty, a null id is ordered first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("_tie", F.md5("text"))
    rows = with_next(rows, ["text", "sketch"], derive={"sketch": sketch(F.col("text"), width, scale)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return rows.select("doc_id", "n_chars", "edited", "sketch", "next_sketch", sketch(F.col("edited"), width, scale).alias("edited_sketch"))
