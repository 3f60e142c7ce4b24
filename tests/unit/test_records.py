"""The keyed_records source: round trips, splits, pruning, failed writes."""

import os

import pytest
from pyspark.sql import functions as F

from threadloom.sources import records as R
from threadloom.sources.text import ALIGNMENTS


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    R.register(spark)


def sample(spark, n=1000):
    i = F.col("id")
    return spark.range(n).select(
        i.alias("index"), (i % 2 == 0).alias("is_phoneme"), F.lit(None).cast("boolean").alias("is_audio"),
        F.transform(F.sequence(F.lit(0), (i % 4).cast("int")), lambda k: F.concat(F.lit("é\n\""), k.cast("string"))).alias("caption"),
        F.when(i % 3 > 0, F.array(F.lit("dog"), F.lit(None).cast("string"))).alias("image_concepts"),
        F.array((i % 5).cast("int")).alias("alignment"), F.array(F.array(i / 7)).alias("align_probs"))


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_round_trip(spark, tmp_path, split):
    n = 20 if split == 40 else 1000
    df = sample(spark, n).repartition(3)
    df.write.format(R.FORMAT).mode("append").save(f"{tmp_path}/t")
    back = spark.read.format(R.FORMAT).option("split_bytes", split).load(f"{tmp_path}/t")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert rows(back) == rows(df)
    assert back.rdd.getNumPartitions() >= 3
    assert rows(spark.read.format(R.FORMAT).schema(ALIGNMENTS).load(f"{tmp_path}/t")) == rows(df)


def test_append_overwrite_empty(spark, tmp_path):
    path = f"{tmp_path}/t"
    write = lambda df, mode: df.write.format(R.FORMAT).mode(mode).save(path)
    write(sample(spark, 10), "append")
    write(sample(spark, 10), "append")
    assert spark.read.format(R.FORMAT).load(path).count() == 20
    write(sample(spark, 7), "overwrite")
    assert spark.read.format(R.FORMAT).load(path).count() == 7
    assert len([f for f in os.listdir(path) if f.startswith("job-")]) == 1
    write(sample(spark, 0), "overwrite")
    assert spark.read.format(R.FORMAT).load(path).count() == 0


def test_filters_leave_out_parts(spark, tmp_path):
    df = sample(spark).repartitionByRange(8, "index")
    df.write.format(R.FORMAT).mode("append").save(f"{tmp_path}/t")
    back = spark.read.format(R.FORMAT).load(f"{tmp_path}/t")
    for cond in ("index = 500", "index >= 900", "index < 40", "index in (3, 998)", "index > 5 and index <= 6", "index = 5000", "index is null", "index <> 5", "index = 3 or index = 4"):
        assert rows(back.where(cond)) == rows(df.where(cond)), cond
    assert back.rdd.getNumPartitions() == 8
    assert back.where("index = 500").rdd.getNumPartitions() == 1
    assert back.where("index in (3, 998)").rdd.getNumPartitions() == 2


def test_null_and_text_keys(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5), (None, 2.5), ("a", None), ("é", 0.1)], "concept string, p double").coalesce(1)
    df.write.format(R.FORMAT).option("key", "concept").mode("append").save(f"{tmp_path}/t")
    back = spark.read.format(R.FORMAT).option("key", "concept").load(f"{tmp_path}/t")
    for cond in ("true", "concept is null", "concept = 'é'", "concept > 'a'"):
        assert rows(back.where(cond)) == rows(df.where(cond))


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    sample(spark, 10).write.format(R.FORMAT).mode("append").save(path)
    before = sorted(os.listdir(path))
    bad = sample(spark, 100).repartition(4).withColumn("index", F.when(F.col("index") == 99, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("index")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="lost"):
            bad.write.format(R.FORMAT).mode(mode).save(path)
        assert sorted(os.listdir(path)) == before
        assert spark.read.format(R.FORMAT).load(path).count() == 10


def test_no_key(spark, tmp_path):
    with pytest.raises(Exception, match="no column"):
        sample(spark, 3).write.format(R.FORMAT).option("key", "nothing").mode("append").save(f"{tmp_path}/t")
