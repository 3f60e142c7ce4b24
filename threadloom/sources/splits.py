"""Line, record and block numbers of text files read in splits.

A text file's splits are read by different tasks, none of which knows how many
lines come before its own. One pass counts the lines of each split; running sums
of these counts (a row per split) give every split its first number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits up to this number (about 100 bytes each) are broadcast with their first numbers.
_SPLITS = 1 << 18


def numbered_lines(spark: SparkSession, path: str, across: bool = False, sep: str = "\n") -> DataFrame:
    """``file, at, line``: the lines under ``path``, numbered from 0 in each file
    or, ``across`` files, in the order of their names.

    Files are split as ``spark.sql.files.maxPartitionBytes`` says; no file is
    read whole. Lines of a split are consecutive in its task, so a line's place
    is its row id less the split's first. Both readings are parts of one plan
    and see the same splits. A line feed at a file's end ends its last line.
    """
    t = spark.read.option("lineSep", sep).text(path)
    rows = t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    counts = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first"))
    order = Window.orderBy("file", "split") if across else Window.partitionBy("file").orderBy("split")
    starts = counts.select("file", "split", (F.sum("n").over(order) - F.col("n") - F.col("_first")).alias("_start"))
    if len(t.inputFiles()) + t.rdd.getNumPartitions() <= _SPLITS:
        starts = F.broadcast(starts)
    return rows.join(starts, ["file", "split"]).select("file", (F.col("_id") + F.col("_start")).alias("at"), "line")


def running_sum(rows: DataFrame, value: Column, name: str, key: str = "file", at: str = "at", size: int = 4096) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of ``key`` before
    each, by ``at`` (distinct within a key). In two levels: inside chunks of
    ``size`` numbers, and over the chunks' sums."""
    rows = rows.withColumn("_v", value).withColumn("_chunk", F.floor(F.col(at) / size))
    sums = rows.groupBy(key, "_chunk").agg(F.sum("_v").alias("_sum"))
    base = sums.select(key, "_chunk", (F.sum("_sum").over(Window.partitionBy(key).orderBy("_chunk")) - F.col("_sum")).alias("_base"))
    inner = F.sum("_v").over(Window.partitionBy(key, "_chunk").orderBy(at)) - F.col("_v")
    return rows.withColumn("_inner", inner).join(base, [key, "_chunk"]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_v", "_chunk", "_inner", "_base")


def number_blocks(lines: DataFrame) -> DataFrame:
    """S23 over splits: ``file, pair_index, k, frame`` of the numbers on
    ``file, at, line``: a block is what stands between blank lines, ``k`` counts
    a block's numbers whatever lines they stand on."""
    blank = F.length(F.trim("line")) == 0
    held = running_sum(lines.withColumn("line", F.regexp_replace("line", r"\s", " ")), blank.cast("long"), "_gap").where(~blank)
    blocks = running_sum(held.select("file", "_gap").distinct(), F.lit(1).cast("long"), "pair_index", at="_gap")
    words = F.filter(F.split(F.trim("line"), " +"), lambda x: x != "")
    counted = running_sum(held.withColumn("_words", words), F.size("_words").cast("long"), "_before")
    first = counted.groupBy("file", "_gap").agg(F.min("_before").alias("_first"))
    rows = counted.join(first, ["file", "_gap"]).join(blocks, ["file", "_gap"])
    rows = rows.select("file", "pair_index", (F.col("_before") - F.col("_first")).alias("_k"), F.posexplode("_words").alias("_i", "_w"))
    return rows.select("file", "pair_index", (F.col("_k") + F.col("_i")).alias("k"), F.col("_w").cast("long").alias("frame"))
