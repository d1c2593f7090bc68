"""The registered queries of this package and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernsift.llm import checks
from fernsift.llm.shared import read, shared_folder


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fernsift.llm import token_files

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_folder(spark, "token-files")
    token_files.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.lookup(docs.select("doc_id"), folder, digest=True)


def op2_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernsift.llm import secret_owners

    return secret_owners.scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernsift.llm import mixing

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "mixed.size", "mixed.source_size", "mixed.target", "mixed.taken")


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernsift.llm import vector_dedup

    return vector_dedup.dedup(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernsift.llm import line_templates

    cleaned = line_templates.drop_recurring(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_dropped", "text")


def op6_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernsift.llm import url_vocabulary

    judged = url_vocabulary.judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernsift.llm import quality_cascade

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_cascade.cascade(docs, measures=True)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fernsift.llm import bpe

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernsift.llm import minhash_dedup

    return minhash_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), size=4)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernsift.llm import toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "evidence")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernsift.llm import hard_negatives

    key, label = F.col("vec_id"), F.col("label").cast("long")
    shifted = F.when(key % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), anchors=key % 100 == 0, label=shifted)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernsift.llm import spelling

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.group(docs, damage_every=spelling.DAMAGED)


def op13_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernsift.llm import permutation_index

    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation_index.search(table, asking=F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_files,
        op2_secret_owners,
        op3_mixing,
        op4_vector_dedup,
        op5_line_templates,
        op6_url_vocabulary,
        op7_quality_cascade,
        op8_bpe_round_trip,
        op9_minhash_dedup,
        op10_toxicity,
        op11_hard_negatives,
        op12_spelling_variants,
        op13_permutation_index,
    )
}

SQL: dict[str, str] = {
    "op3_mixing": checks.MIXING,
    "op4_vector_dedup": checks.VECTORS,
    "op5_line_templates": checks.LINES,
    "op6_url_vocabulary": checks.URLS,
    "op7_quality_cascade": checks.QUALITY,
    "op9_minhash_dedup": checks.NEAR,
    "op11_hard_negatives": checks.NEGATIVES,
    "op12_spelling_variants": checks.SPELLING,
}
