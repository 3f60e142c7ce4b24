"""Writers and text projections of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = "pair_index"


def joined(df: DataFrame, value: str, sep: str = " ", key: str = PAIR, pos: str = "pos") -> DataFrame:
    """One line per pair: its values in order."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(pos, value))), lambda x: x[value])
    return df.groupBy(key).agg(F.array_join(items, sep).alias("line"))


def parallel_text(src: DataFrame, trg: DataFrame) -> DataFrame:
    """``pair_index, src, trg``: parallel sentences for translation tools."""
    return joined(src, "token").withColumnRenamed("line", "src").join(joined(trg, "concept").withColumnRenamed("line", "trg"), PAIR)


def index_triples(df: DataFrame, vocab: DataFrame, value: str) -> DataFrame:
    """``doc, word``: 1-based indices of pairs and vocabulary entries."""
    return df.join(vocab.select(F.col("token").alias(value), "token_id"), value).select((F.col(PAIR) + 1).alias("doc"), (F.col("token_id") + 1).alias("word"))


def letter_text(df: DataFrame, letters: DataFrame, runs: DataFrame) -> DataFrame:
    """One letter per token, a space where a new segment starts."""
    t = df.join(letters, "token")
    r = runs.select(F.col(PAIR).alias("k"), F.col("start").alias("s"))
    j = t.join(r, (F.col(PAIR) == F.col("k")) & (F.col("pos") == F.col("s")) & (F.col("pos") > 0), "left")
    return joined(j.withColumn("cell", F.concat(F.when(F.col("s").isNotNull(), F.lit(" ")).otherwise(F.lit("")), "letter")), "cell", sep="")


def text_pair_blocks(src: DataFrame, trg: DataFrame) -> DataFrame:
    """``concepts\\nsentence\\n`` blocks."""
    p = parallel_text(src, trg)
    return p.select(PAIR, F.concat_ws("\n", "trg", "src", F.lit("")).alias("block"))


def word_units(segments: DataFrame, value: str) -> DataFrame:
    """``pair start end label`` unit lines."""
    return segments.select(F.format_string("pair_%d %d %d %s", PAIR, "start", "end", F.col(value).cast("string")).alias("line"))


def word_classes(segments: DataFrame, value: str) -> DataFrame:
    """Per class its member lines, in order, as one block."""
    member = F.format_string("pair_%d %d %d", PAIR, "start", "end")
    g = segments.groupBy(F.col(value).alias("cls")).agg(F.transform(F.sort_array(F.collect_list(F.struct(PAIR, "start", member.alias("m")))), lambda x: x["m"]).alias("m"))
    return g.select("cls", F.concat(F.format_string("Class %d:\n", "cls"), F.array_join("m", "\n"), F.lit("\n")).alias("block"))


def write_alignments(df: DataFrame, path: str, form: str = "json") -> None:
    """One JSON record per pair, or ``pair pos target`` text lines."""
    if form == "json":
        df.write.mode("overwrite").json(path)
    else:
        df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])).write.mode("overwrite").text(path)


def write_parameters(df: DataFrame, path: str) -> None:
    """A parameter table as tab-separated text."""
    df.write.mode("overwrite").csv(path, sep="\t")
