"""Seeded draws and corpus samplers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_uniform(c: Column) -> Column:
    """A number in [0, 1) from the MD5 of the value: the same at every run."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def cumulative(weights: DataFrame, item: str, weight: str = "weight") -> DataFrame:
    """``item, low, cum``: the slice of [0, 1) that each item owns, in item order."""
    w = Window.orderBy(item)  # a row per class
    whole = Window.partitionBy()
    cum = F.sum(weight).over(w) / F.sum(weight).over(whole)
    return weights.select(item, cum.alias("cum")).withColumn("low", F.coalesce(F.lag("cum").over(w), F.lit(0.0)))


def draw(weights: DataFrame, uniforms: DataFrame, item: str, weight: str = "weight") -> DataFrame:
    """Inverse-CDF draws; each row of ``uniforms`` (``u``) gets the
    item whose slice holds its number. The class table is the small side."""
    c = cumulative(weights, item, weight)
    return uniforms.join(c, (F.col("u") >= F.col("low")) & (F.col("u") < F.col("cum"))).drop("low", "cum")


def _seeded(key: str, seed: int):
    """A hash of the key under a seed, for orders that repeat anywhere."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in a random order fixed by the seed, with their place."""
    return df.withColumn("r", _seeded(key, seed)).orderBy("r", key)


def power_law_counts(classes: DataFrame, label: str, total: int, alpha: float = 1.0) -> DataFrame:
    """How many examples to take of each class: rank ** -alpha shares of
    ``total`` by falling frequency, never more than the class has."""
    w = Window.orderBy(F.desc("n"), label)  # a row per class
    r = classes.withColumn("rank", F.row_number().over(w)).withColumn("share", F.pow("rank", F.lit(-alpha)))
    want = F.floor(F.lit(total) * F.col("share") / F.sum("share").over(Window.partitionBy()))
    return r.select(label, "n", F.least(F.col("n"), want).alias("take"))


def sample_classes(df: DataFrame, label: str, key: str, take: DataFrame, seed: int) -> DataFrame:
    """The first ``take`` rows of each class in a seeded order, each used once."""
    w = Window.partitionBy(label).orderBy(_seeded(key, seed), key)
    j = df.join(take.select(label, "take"), label)
    return j.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("take")).drop("_n", "take")


def noisy_copies(centroids: DataFrame, per: int, snr_db: float, seed: int) -> DataFrame:
    """``per`` Gaussian copies of each centroid with noise 10 * 10 ** (-snr/20)."""
    scale = 10 * 10 ** (-snr_db / 20)
    e = centroids.select("*", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("copy"))
    x = e.select("concept", "copy", F.posexplode("mean").alias("i", "x")).withColumn("x", F.col("x") + F.randn(seed) * scale)
    return x.groupBy("concept", "copy").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("vec"))
