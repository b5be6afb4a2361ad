"""A corpus pipeline in five stages: language, exact copies, near copies, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import decontam, exact, language, near, sentencepiece_rounds, simhash
from cuelake.llm.common import bounded_batches, scratch, tables, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier accepts; it learns from those outside the held-out fold."""
    model = language.train(docs.filter(~language.in_fold(F.col("doc_id"))))
    columns = docs.columns
    return language.classify(docs, model).filter(~F.col("rejected")).select(*columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact.keep_exact(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies.

    Texts link when their 64-bit fingerprints differ in four bits or fewer, found by pivot distance tables as in op3, and
    besides when their five-word shingles are alike by 0.8 or more, which fingerprints lose mostly at this similarity (see README).
    """
    return near.keep_one(docs, also=written(simhash.near_duplicates(docs), "near-fingerprints"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.without_leaks(docs, tables(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and what they decode to, as digests."""
    return sentencepiece_rounds.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("decontaminate", without_benchmark),
    ("sentencepiece", token_ids),
]

# No stage but the exact one can be said in SQL; tests/llm/test_queries.py holds the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
