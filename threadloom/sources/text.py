"""Readers of corpus text formats, as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALIGNMENTS = "index long, is_phoneme boolean, is_audio boolean, caption array<string>, image_concepts array<string>, alignment array<int>, align_probs array<array<double>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, line``: the lines of each file, numbered from 0. A file is
    read whole, as line numbers need its beginning."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return t.withColumn("at", F.col("at").cast("long"))


def triples(rows: DataFrame, null: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records of three lines (targets, source, blank) from ``at, line``:
    (source tokens, target tokens); ``null`` puts 'NULL' before the targets."""
    r = rows.withColumn("pair_index", F.floor(F.col("at") / 3)).where(F.length(F.trim("line")) > 0)
    words = F.filter(F.split(F.trim("line"), "\\s+"), lambda w: w != "")
    explode = lambda c, name: r.where(F.col("at") % 3 == (1 if name == "token" else 0)).select("pair_index", F.posexplode(c).alias("pos", name))
    src = explode(words, "token")
    trg = explode(F.concat(F.array(F.lit("NULL")), words) if null else words, "concept")
    cast = lambda df: df.withColumn("pos", F.col("pos").cast("long"))
    return cast(src), cast(trg)


def sentences(rows: DataFrame) -> DataFrame:
    """One sentence per line: ``pair_index, pos, token``."""
    words = F.filter(F.split(F.trim("line"), "\\s+"), lambda w: w != "")
    return rows.where(F.length(F.trim("line")) > 0).select(F.col("at").alias("pair_index"), F.posexplode(words).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def alignments(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Alignment records, as JSON lists (a file each) or, ``by_line``, a
    record a line, which any number of tasks can share."""
    return spark.read.schema(ALIGNMENTS).json(path, multiLine=not by_line)


def parameters(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated parameter tables."""
    return spark.read.csv(path, sep="\t", schema=schema)


def word_times(rows: DataFrame) -> DataFrame:
    """``word begin end`` lines."""
    p = F.split(F.trim("line"), "\\s+")
    return rows.where(F.size(p) >= 3).select("at", p[0].alias("word"), p[1].cast("double").alias("begin"), p[2].cast("double").alias("end"))


def tagged_phrases(rows: DataFrame, line: str = "line") -> DataFrame:
    """Bracketed phrases ``[/EN#id/type word word]`` of caption lines:
    ``at, k, entity, type, phrase``."""
    found = F.regexp_extract_all(F.col(line), F.lit(r"\[/EN#(\d+)/(\S+) ([^\]]*)\]"), F.lit(0))
    e = rows.select("at", F.posexplode(found).alias("k", "p"))
    part = lambda i: F.regexp_extract("p", r"\[/EN#(\d+)/(\S+) ([^\]]*)\]", i)
    return e.select("at", F.col("k").cast("long").alias("k"), part(1).alias("entity"), part(2).alias("type"), part(3).alias("phrase"))


def region_labels(boxes: DataFrame, labels: DataFrame, drop: tuple[str, ...] = ("NONVISUAL",)) -> DataFrame:
    """Box lines (``image x y w h``) zipped with label lines by number."""
    p = F.split(F.trim("line"), "\\s+")
    b = boxes.where(F.size(p) >= 5).select("at", p[0].alias("image_key"), *[p[i + 1].cast("int").alias(c) for i, c in enumerate("xywh")])
    return b.join(labels.select("at", F.trim("line").alias("concept")), "at").where(~F.col("concept").isin(*drop))


def merged_reports(records: DataFrame, end: str = "</s>") -> DataFrame:
    """Attention reports: end marks leave the source, and alignments to
    positions behind the concepts fall back to the last one."""
    keep = F.transform(F.filter(F.arrays_zip("caption", "alignment"), lambda x: x["caption"] != end), lambda x: x)
    n = F.size(F.filter("image_concepts", lambda c: c != end))
    return records.select("index", F.transform(keep, lambda x: x["caption"]).alias("caption"), F.filter("image_concepts", lambda c: c != end).alias("image_concepts"), F.transform(keep, lambda x: F.least(x["alignment"], n - 1)).alias("alignment"))


def retrieval_tuples(rows: DataFrame, line: str = "line") -> DataFrame:
    """``(id, score)`` tuples printed on a line: ``at, rank, item, score``."""
    pattern = r"\((\d+), *(-?[0-9.]+(?:e-?\d+)?)\)"
    e = rows.select("at", F.posexplode(F.regexp_extract_all(F.col(line), F.lit(pattern), F.lit(0))).alias("k", "p"))
    return e.select("at", (F.col("k") + 1).cast("long").alias("rank"), F.regexp_extract("p", pattern, 1).cast("long").alias("item"), F.regexp_extract("p", pattern, 2).cast("double").alias("score"))


def segment_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of numbers separated by blank lines: ``pair_index, k, frame``."""
    return blocks_of(spark.read.text(path, wholetext=True)).select("pair_index", "k", "frame")


def blocks_of(texts: DataFrame, text: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """The same from whole texts in a column; ``carry`` names columns to keep."""
    t = texts.select(*carry, F.posexplode(F.filter(F.split(text, "\n\\s*\n"), lambda x: F.trim(x) != "")).alias("pair_index", "block"))
    numbers = F.filter(F.split(F.trim("block"), "\\s+"), lambda x: x != "")
    return t.select(*carry, F.col("pair_index").cast("long").alias("pair_index"), F.posexplode(numbers).alias("k", "frame")).select(*carry, "pair_index", F.col("k").cast("long").alias("k"), F.col("frame").cast("long").alias("frame"))


def paired_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Caption annotations as JSON: one row per annotation with its boxes.
    (The SQLite half of that corpus needs a JDBC driver and isn't read here.)"""
    return spark.read.json(path, multiLine=True)
