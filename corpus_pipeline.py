"""A training corpus in five stages, each on what its predecessor kept.

All stages judge rows, not doc_ids: a row with a null or repeated doc_id, a null text or extra columns is
treated like any other, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import exact_dedup, ngram_join, packing, quality_classifier, quality_rules
from cohortlens.llm.storage import mark, pin, release, unpin
from cohortlens.session import ship


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps.  Null text, language or source is a value like another;
    with fewer than two labelled documents of a class all rows stay."""
    return quality_classifier.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules; null and empty texts fail."""
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside; null counts as empty): the longest text, then
    the smallest doc_id, null last."""
    return exact_dedup.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest doc_id, null last.  Texts without words stay."""
    ship(spark)
    return ngram_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining rows in token sequences, with their ids; a null text is its end mark alone."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", classified), ("quality rules", ruled), ("exact dedup", distinct), ("n-gram join", dissimilar), ("packing", packed)]

#: Trained models, signature trees and a tokenizer: SQL cannot express the stages; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's intermediate tables and its input go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        since, before = mark(), docs
        docs = pin(stage(spark, before, sf_dir))
        release(since, docs)
        unpin(before)
    return STAGES[-1][1](spark, docs, sf_dir)
