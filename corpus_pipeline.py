"""Corpus pipeline: toxicity, exact dedup, near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.bpe import encode_texts
from threadloom.llm.common import cut, read
from threadloom.llm.exact import drop_exact
from threadloom.llm.minhash import drop_near
from threadloom.llm.mixing import mix, mixed_order
from threadloom.llm.toxicity import drop_toxic, fit

#: A text's place in the mix.
PLACE = ("slot", "bucket", "in_bucket")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go; the model is fitted on labelled rows.
    Null and empty texts score as a sentence without evidence; repeated rows
    score alike; rows of one id are scored each by its own text."""
    return drop_toxic(docs, fit(docs, read(spark, sf_dir, "labels")), cutoff=0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased; null counts as empty) the smallest id
    stays, with all its repeated rows; rows without an id stay."""
    return drop_exact(docs, keep="min")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 over 5-word shingles the smallest id stays,
    with all its rows. Texts without words and rows without an id link with
    nothing and stay."""
    return drop_near(docs, threshold=80, width=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, interleaved by source at weights in proportion to size ** 0.5;
    the decision is the order of the written rows, and ``encoding`` names it. A
    null source is one of its own; columns of any name are kept."""
    return mixed_order(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, the digest of what they decode to, and the text's
    place in the mix: reading by ``slot, bucket, in_bucket`` is its order. Files
    are not read in the order they were written in, so the mix (which depends on
    the rows only) is made again, and the rows are sorted by it."""
    import public_tokenizers

    rows = mix(docs, carry=["doc_id", "text"]).orderBy(*PLACE).select("row.*", *PLACE)
    return encode_texts(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "tokens", "decoded_sha256"), carry=PLACE)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup), ("mixing sources", mixing), ("BPE encoding", encoding)]

#: The first stage is a trained model: SQL has no equal.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
