"""The registered query of each operator, with production parameters over whole tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import embeddings, language, minhash, packing, quality, secret_scan, substrings, token_counts, toxicity, transducer
from tessera.llm.oracles import ORACLE

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """Of the checksum that splits rows into learned and held out; NULL without an id: such a row neither teaches nor is held out."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def held_out(n: int, rest: int):
    return F.coalesce(remainder(n) == rest, F.lit(False)).alias("held_out")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = language.identify(table(spark, sf_dir, "documents"), learn=remainder(4) != 2)
    return got.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", learn=remainder(3) != 1)
    return got.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.digests(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_rules": op7_quality_rules,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_retrieval_packing": op10_retrieval_packing,
}
