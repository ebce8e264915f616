"""A training-data pipeline: five stages over ``documents``, each one operator of ``zipledger.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``; rows are dropped or texts shortened, and every stage works on all that its
predecessor kept. Nulls, empty texts, repeated rows, empty tables and extra columns have
the results that the operators' docstrings define.

ORACLE_SQL is None: the scores of a fitted clause grammar are not SQL. The stages are
tested against brute-force versions in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zipledger.llm import decontaminate, minhash, packing, suffix_array, toxicity
from zipledger.llm.common import ship, stage, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    ship(spark)
    return toxicity.keep(docs, table(spark, sf_dir, "labels"), limit=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (from 0.80 on): the one with the least doc_id."""
    ship(spark)
    return minhash.keep(docs, similarity=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that 50-byte strings of earlier documents cover.

    ``n_chars``, where there is one, is the length of the remaining text.
    """
    ship(spark)
    kept = suffix_array.remove(docs, length=50)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten benchmark words."""
    ship(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), n=10, what="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    ship(spark)
    return packing.pack(docs, end_id=1, size=2048)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
