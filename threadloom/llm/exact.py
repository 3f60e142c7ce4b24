"""Exact dedup: 128-bit content hash, byte comparison, one stable survivor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] = lower_ascii,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by a 128-bit hash of the normalised text (the first half of
    its SHA-256) *and* its bytes, so a hash collision never merges two texts. The
    aggregation combines on the map side: a group of any size reaches its
    reducer as one row per task. Texts cross the network once, at most once per
    task and distinct text; the second pass joins rows of an id and a digest
    only, and adaptive execution splits a hot group.

    ``keep``: ``min`` keeps the smallest id, ``max`` the largest.

    Nulls: a null text counts as empty. A null id never survives over another
    id; a group of null ids only has a null ``keep_id`` and is kept whole.
    Repeated rows: rows that share the surviving id are each ``kept``.
    Other columns, also of the names used here, are ignored.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    rows = rows.select("doc_id", "norm", F.sha2("norm", 256).alias("sha"))
    key128 = F.unhex(F.substring("sha", 1, 32)).alias("key128")
    classes = (
        rows.select("doc_id", "norm", "sha", key128)
        .groupBy("key128", "norm")
        .agg(F.min(F.unhex("sha")).alias("sha"), pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("sha", "keep_id", "group_size")
    )
    light = rows.select("doc_id", F.unhex("sha").alias("sha"))
    return light.join(classes, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_exact(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = lower_ascii) -> DataFrame:
    """The rows of ``docs`` that survive, with their own columns and no others.

    A row goes by its id and its text: of rows that share an id, those with
    other texts are judged in their own groups. Rows whose id is null have no
    identity to drop them by and stay.
    """
    groups = exact_groups(docs, id_col, text_col, keep, normalise)
    losers = groups.where(~F.col("kept")).select(F.col("doc_id").alias("_loser"), F.col("text_sha256").alias("_lost")).distinct()
    sha = "_sha"
    while sha.lower() in map(str.lower, docs.columns):
        sha += "_"
    rows = docs.withColumn(sha, F.sha2(normalise(F.coalesce(F.col(text_col), F.lit(""))), 256))
    return rows.join(losers, (rows[id_col] == losers["_loser"]) & (rows[sha] == losers["_lost"]), "left_anti").drop(sha)
