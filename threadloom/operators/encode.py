"""Encoders, filters and splits of token tables and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.shared import keep

PAIR = "pair_index"


def ranked(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in the given order.

    Rows are dealt by range, ranked inside their partition and shifted by the
    sizes of the partitions before it, so no task holds the table. The dealt
    rows must not be dealt anew for the second read: they are written to the
    shared folder.
    """
    dealt = keep(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = dealt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    first = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_first"))
    at = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return dealt.withColumn("_at_", at).join(F.broadcast(first), "_pid").withColumn(name, (F.col("_first") + F.col("_at_")).cast("long")).drop("_pid", "_at_", "_first")


def vocabulary(df: DataFrame, token: str = "token", order: str = "first_seen", key: str = PAIR, pos: str = "pos") -> DataFrame:
    """``token, token_id``; by first appearance in (pair, position) order, or
    ``sorted``."""
    if order == "sorted":
        return ranked(df.select(token).distinct(), [token], "token_id")
    seen = df.groupBy(token).agg(F.min(F.struct(key, pos)).alias("_seen"))
    return ranked(seen, ["_seen"], "token_id").select(token, "token_id")


def one_hot(token_id: Column, size: int) -> Column:
    """A 0/1 array; the engine itself keeps sparse ids."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == token_id).cast("int"))


def prepend_null(df: DataFrame, concept: str = "concept", key: str = PAIR) -> DataFrame:
    """The concept ``'NULL'`` at position 0 of every pair."""
    rest = df.select(key, (F.col("pos") + 1).alias("pos"), concept)
    return df.select(key).distinct().select(key, F.lit(0).cast("long").alias("pos"), F.lit("NULL").alias(concept)).unionByName(rest)


def stack_context(df: DataFrame, vec: str, dim: int, width: int, key: str = PAIR, pos: str = "pos") -> DataFrame:
    """Each vector between its ``width`` neighbours on both sides; zeros
    beyond the ends."""
    w = Window.partitionBy(key).orderBy(pos)
    zero = F.array_repeat(F.lit(0.0), dim)
    parts = [F.coalesce(F.lag(vec, d).over(w) if d > 0 else F.lead(vec, -d).over(w) if d < 0 else F.col(vec), zero) for d in range(width, -width - 1, -1)]
    return df.select(key, pos, F.flatten(F.array(*parts)).alias(vec))


def preemphasis(df: DataFrame, value: str, coeff: float = 0.97, key: str = PAIR, pos: str = "pos") -> DataFrame:
    """y[t] - c y[t-1]; the first sample stays."""
    w = Window.partitionBy(key).orderBy(pos)
    return df.withColumn(value, F.col(value) - coeff * F.coalesce(F.lag(value).over(w), F.lit(0.0)))


def normalise_by(df: DataFrame, value: str, by: Sequence[str], floor: float = 1e-12) -> DataFrame:
    """Subtract the group's mean, divide by its population deviation.
    Statistics are aggregated first, so no group meets in one task."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    return df.join(stats, list(by)).withColumn(value, (F.col(value) - F.col("_m")) / F.sqrt(F.greatest("_v", F.lit(floor)))).drop("_m", "_v")


def strip_stress(phone: Column) -> Column:
    """A trailing stress digit goes."""
    return F.regexp_replace(phone, "[0-9]$", "")


def lexicon_lookup(df: DataFrame, lexicon: DataFrame, token: str = "token", unknown: str = "UNK", small: bool = False) -> DataFrame:
    """Left join to (word, phones); words not found give ``unknown``."""
    lex = F.broadcast(lexicon) if small else lexicon
    return df.join(lex, df[token] == lex["word"], "left").withColumn("phones", F.coalesce("phones", F.array(F.lit(unknown)))).drop("word")


def first_occurrence(words: DataFrame, synonyms: DataFrame, key: str = PAIR) -> DataFrame:
    """For each pair and concept the earliest position at which one of the
    concept's synonyms stands, alone or as two words joined by a space."""
    w = Window.partitionBy(key).orderBy("pos")
    two = words.withColumn("_two", F.concat_ws(" ", "token", F.lead("token").over(w)))
    forms = two.select(key, "pos", F.explode(F.array_distinct(F.array("token", "_two"))).alias("_form"))
    hit = forms.join(synonyms.select("concept", F.col("form").alias("_form")), "_form")
    return hit.groupBy(key, "concept").agg(F.min("pos").alias("pos"))


def phrase_start(tokens: Column, phrase: Column) -> Column:
    """Index of the token at which ``phrase`` starts as a substring of the
    joined tokens; -1 if absent."""
    joined = F.array_join(tokens, " ")
    at = F.position(phrase, joined)
    before = F.substr(joined, F.lit(1), at - 1)
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))))


def to_samples(seconds: Column, rate: int) -> Column:
    """P20: seconds to samples, towards zero."""
    return (seconds * rate).cast("long")


def to_frames(samples: Column, hop: int) -> Column:
    return F.floor(samples / hop)


def numeric_suffix(name: Column, sep: str = "_") -> Column:
    """The integer after the last separator."""
    return F.element_at(F.split(name, sep), -1).cast("long")


def pretty_alignment(src: Column, trg: Column) -> Column:
    """One ``source -> target`` item for display."""
    return F.format_string("%s -> %s", src, trg)


def drop_null_aligned(df: DataFrame, alignment: str = "alignment", key: str = PAIR) -> DataFrame:
    """positions aligned to target 0 (NULL) go, the others shift by one and
    are renumbered; a pair left empty disappears."""
    w = Window.partitionBy(key).orderBy("pos")
    kept = df.where(F.col(alignment) != 0)
    return kept.select(key, (F.row_number().over(w) - 1).cast("long").alias("pos"), "token", (F.col(alignment) - 1).alias(alignment))


def top_classes(df: DataFrame, label: str, k: int) -> DataFrame:
    """The ``k`` most frequent labels, ties by label."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(k)


def keep_top_concepts(df: DataFrame, k: int, concept: str = "concept", key: str = PAIR) -> DataFrame:
    """rows of the ``k`` most frequent concepts, each pair's concepts
    numbered again by first use. The ``k`` labels are broadcast."""
    top = F.broadcast(top_classes(df, concept, k).select(concept))
    kept = df.join(top, concept, "left_semi")
    w = Window.partitionBy(key).orderBy("pos")
    return kept.select(key, (F.row_number().over(w) - 1).cast("long").alias("pos"), concept)


def at_least(df: DataFrame, label: str, n: int) -> DataFrame:
    """labels with at least ``n`` rows."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)


def split_by_ids(df: DataFrame, ids: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is listed, the others)."""
    return df.join(ids, on, "left_semi"), df.join(ids, on, "left_anti")


def hash_split(df: DataFrame, key: str, parts: int, test: int) -> DataFrame:
    """``is_train`` by the MD5 of the key, the same at every run."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(parts))
    return df.withColumn("is_train", bucket >= test)


def cap_per_class(df: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """the first ``n`` rows of every class; the cap is the operator."""
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
