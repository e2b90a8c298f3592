"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing, one after the other on documents.

Each stage works on all rows that the one before it left. An empty table gives an empty one at every stage; columns beyond
those that a stage reads (doc_id, text, lang, source, n_chars) pass through it, but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import exact_dedup, mixing, packing, quality, simhash
from lexloom.llm.common import discard, materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity bands.

    Null and empty texts fail the base rules; a null lang is a language of its own; a null doc_id has no label; rows equal in
    doc_id, lang and text go or stay together; very long texts are scored whole."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest doc_id.

    Null texts equal empty ones; a null doc_id loses to any other; of rows that tie in text and doc_id one stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest doc_id.

    Texts without words have fingerprint zero and are linked like any other; a null doc_id stays only if its class has no
    other; of rows that tie in doc_id, that of the least text hash stays."""
    return simhash.near_deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, a row for each pass that takes some of one.

    Null texts and those without words take part in nothing; a null source is one like others; repeated rows are documents
    of their own; text is what the mix takes, n_chars its length, all other columns are the document's."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; workers that hold other stages' memory get a small memo.

    A null text is its end id alone; ties and repeated rows are packed like others; only texts of over 1024 ids are cut."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, memo=150_000, part=3 << 20)


STAGES = [("quality_rules", keep_good), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: SQL expresses neither the language model nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(spark, last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
