"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner
writes it as Parquet and reads it again as the next stage's docs. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideframe.llm import bpe, mixing, quality_classifier, simhash, suffix_dedup
from strideframe.llm.queries import table, vocabulary
from strideframe.llm.runtime import Scratch

#: Seven tenths of the tokens that reach the mix, no document more than once.
MIX = mixing.Mix(share=700, epochs=1)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accept(docs, table(spark, sf_dir, "labels"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return simhash.keep_one(docs)


def dedup_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings of 200 bytes and more are cut out of the texts."""
    return suffix_dedup.remove_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights."""
    return mixing.mix_sources(docs, MIX).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digest of what the ids decode to."""
    return bpe.encode_rows(docs.select("doc_id", "lang", "source", "text"), vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("simhash_dedup", dedup_near),
    ("suffix_dedup", dedup_strings),
    ("mix_sources", mix),
    ("byte_bpe", tokenise),
]

#: A learned classifier, fingerprints and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
