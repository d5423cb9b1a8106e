"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, with the columns
of documents, and returns what it keeps, with the same columns; the last returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import entries, packing, pii, quality, simhash, suffix_dedup
from paperloom.llm.common import documents, stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: five-word shingles with a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, least=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur elsewhere."""
    return suffix_dedup.without_repeated_words(docs, words=51)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens."""
    return packing.pack(docs, entries.byte_bpe_path(), 2048, entries.PACK_END)


STAGES = [("quality rules", good), ("near-duplicates", one_of_each), ("repeated passages", without_repeats), ("personal data", redacted), ("best-fit packing", packed)]

#: The stages need suffix arrays, fingerprints and a tokenizer, which SQL doesn't have: tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
