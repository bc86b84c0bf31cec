"""The registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import ann, bpe, html_extract, mixing, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, token_counts, toxicity, vector_codes, whitening
from strideframe.llm.runtime import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.measured(table(spark, sf_dir, "documents"))
    return mixing.choose(Scratch(spark).put(docs, "sized"), mixing.Mix())


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(token_counts.sample_edits(table(spark, sf_dir, "documents")), vocabulary())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base rule of op9 reads, without any learning."""
    return quality_rules.base(quality_rules.statistics(table(spark, sf_dir, "documents")))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash_dedup, op2_quality_classifier, op3_mix_sources, op4_html_extract, op5_suffix_dedup, op6_token_counts, op7_sharding, op8_byte_bpe, op9_quality_rules, op10_nearest, op11_whitening, op12_toxicity, op13_vector_codes, text_statistics)}

ORACLES: dict[str, str] = {"op3_mix_sources": mixing.oracle(), "op7_sharding": sharding.oracle(), "text_statistics": quality_rules.base_oracle(), "op13_vector_codes": vector_codes.oracle()}
