"""Component statistics as state: order, repeats, removals, expiry."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.streaming import components as M

SCHEMA = "component long, item long, at long, gone boolean, vec array<double>"


def plain(changes):
    held = {}
    for c, item, at, gone, vec in changes:
        if None in (c, item, at) or (vec is None and not gone):
            continue
        old = held.get((c, item))
        if old is None or (at, gone) > old[:2]:
            held[c, item] = (at, gone, vec)
    out = {}
    for (c, _), (_, gone, vec) in held.items():
        if not gone:
            n, s = out.get(c, (0, [0.0] * len(vec)))
            out[c] = (n + 1, [a + b for a, b in zip(s, vec)])
    return {c: (n, [round(x / n, 6) for x in s]) for c, (n, s) in out.items()}


def found(df):
    return {r["component"]: (r["n"], [round(x, 6) for x in r["mean"]]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_final_members(spark, seed):
    r = random.Random(seed)
    rows = [(r.randrange(3), r.randrange(12), r.randrange(6), r.random() < 0.3, [r.random(), r.random()]) for _ in range(150)]
    # at equal times only a removal may differ: vectors follow from (item, at)
    rows = [(c, i, at, g, None if g else [i + at / 7, i * at / 3.0]) for c, i, at, g, _ in rows] + [(None, 1, 1, False, [1.0, 1.0]), (1, None, 1, False, [1.0, 1.0]), (1, 50, 1, False, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(M.replay(spark, df, 4, salts=2)) == plain(rows)


def test_empty(spark):
    assert M.replay(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_removed(spark):
    rows = [(1, 1, 1, False, [0.1]), (1, 1, 2, True, None)]
    assert M.replay(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect() == []


def test_removal_comes_first(spark, tmp_path):
    """A state that has seen only removals takes vectors later."""
    spark.conf.set(M._PROVIDER, M._ROCKS)
    got = {}

    def take(df, n):
        got.update({r["component"]: (r["n"], r["sums"]) for r in df.collect()})

    for rows in ([(1, 1, 5, True, None)], [(1, 1, 4, False, [9.0]), (1, 2, 1, False, [3.0])]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        M.component_sums(stream, 1).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/log").foreachBatch(take).trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset(M._PROVIDER)
    assert got == {1: (1, [3.0])}


def test_items_end_after_span(spark, tmp_path):
    """Timers take out items whose span is over; a component that saw nothing new
    is updated too."""
    spark.conf.set(M._PROVIDER, M._ROCKS)
    base = 1_700_000_040_000
    steps = [[(1, 1, base, 1.0), (1, 2, base + 300_000, 3.0)], [(2, 9, base + 700_000, 5.0)], [(2, 10, base + 760_000, 7.0)]]
    schema = "component long, item long, at long, gone boolean, vec array<double>"
    got = {}

    def take(df, n):
        for r in df.collect():
            got[r["component"]] = (r["n"], r["sums"])

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "0 seconds")
        M.component_sums(stream, 1, span=600_000).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/log").foreachBatch(take).trigger(availableNow=True).start().awaitTermination()

    for rows in steps:
        spark.createDataFrame([(c, i, at, False, [x]) for c, i, at, x in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    spark.conf.unset(M._PROVIDER)
    assert got[1] == (1, [3.0])
    assert got[2] == (2, [12.0])
