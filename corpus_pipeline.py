"""A cleaning and mixing pipeline over ``documents``; every stage's result is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsift.llm import bpe, line_templates, minhash_dedup, mixing, toxicity
from fernsift.llm.shared import read, store


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity.held_out())
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are cut out of the texts; documents stay."""
    cleaned = line_templates.drop_recurring(docs, into="_dropped").drop("_dropped")
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id."""
    return minhash_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.draw(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, as digests, with a digest of the bytes they decode to."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_recurring_lines),
    ("MinHash near-dedup", without_near_duplicates),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

ORACLE_SQL = None  # signatures, votes and BPE have no SQL form; tests/llm compares with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
