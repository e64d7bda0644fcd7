"""Documents to encoded training data: one table through the stages in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plaintide.llm import byte_bpe, exact_dedup, mixing, order_minhash, quality, scratch
from plaintide.llm.queries import BYTE_BPE, table, tokenizer_file


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network, fitted on `labels`, doesn't reject."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return order_minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to twice, by tempered token shares."""
    return mixing.mixed_documents(docs, mixing.mixing_plan(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids."""
    return byte_bpe.bpe_encode(docs, tokenizer_file(BYTE_BPE))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encode", encode),
]

#: SQL can't express the classifier, the sketches and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's result is written to the shared folder and read again.

    What a stage wrote on its way goes once its result is stored, and so does the result that it read.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, scratch.written_alone(spark, lambda: stage(spark, docs, sf_dir), name)
        scratch.discard(before)
    return docs
