"""A training corpus from raw documents: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage works on all that the one before kept and is written to the shared folder before the next one reads it, so
a lost executor costs one stage at most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import minhash, packing, quality, secret_scan, substrings
from tessera.llm.shared import kept_tables, save

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host stands."""
    return quality.keep_good(docs, "source")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8): the one of least doc_id."""
    return minhash.keep_one(docs, shingle=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out."""
    return substrings.remove_passages(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secret_scan.mask(docs)


def retrieval_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens with lexical neighbours."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scans),
    ("packing", retrieval_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with kept_tables(spark) as tables:
            made = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            tables.keep(made)
            tables.drop_later(docs)  # what the stage read goes with what it wrote on its way
        docs = made
    return docs
