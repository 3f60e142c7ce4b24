"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch


def loose(c: Column) -> Column:
    """The same long under an expression Spark can't see through, so that a
    join on it shuffles both sides and adaptive execution may split a hot key."""
    return c.bitwiseXOR(F.lit(0).cast("bigint"))


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (longs ``a``, ``b``): the
    label is the smallest node reachable. Self-links and nulls are ignored.

    Each round is two map-side combined minima and two joins of 16-byte rows,
    written to the shared folder (and removed, but for the last); the number of
    rounds is logarithmic in practice. Nothing but a checksum reaches the driver.
    """
    with scratch(links.sparkSession) as keep:
        hi, lo = F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")
        edges = cut(links.where("a <> b").select(hi, lo).distinct())
        state = None
        while True:
            both = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(edges.select(F.col("y").alias("u"), F.col("x").alias("v")))
            mins = both.groupBy("u").agg(F.min("v").alias("m")).select(loose(F.col("u")).alias("u"), F.least("u", "m").alias("m"))
            large = both.where("v > u").join(mins, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
            large = cut(large)
            low = large.groupBy("x").agg(F.min("y").alias("m")).select(loose(F.col("x")).alias("x"), "m")
            small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
            edges = cut(small.unionByName(low.select("x", F.col("m").alias("y"))).distinct())
            now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.xxhash64("y", "x") % 1000003)).first()
            if now == state:
                break
            state = now
        keep(edges)
    return edges.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct())
