"""Column statistics, equi-depth histogram with selectivities, and distinct-count sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ordering import numbered


def column_stats(df: DataFrame, column: str, exact: bool = False) -> DataFrame:
    """One row: rows, null_count, ndv, mi, ma. ndv is a HyperLogLog++ estimate unless exact."""
    ndv = F.count_distinct(column) if exact else F.approx_count_distinct(column)
    return df.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count(column)).alias("null_count"), ndv.alias("ndv"), F.min(column).alias("mi"), F.max(column).alias("ma"))


def equi_depth_exact(df: DataFrame, column: str, tie: str, buckets: int) -> DataFrame:
    """bucket, mi, ma, cnt, ndv with NTILE's bucket sizes, ties broken by `tie`."""
    ranked = numbered(df.where(F.col(column).isNotNull()).select(column, tie), column, tie)
    rank, small, more = F.col("__n"), F.floor(F.col("__all") / buckets), F.col("__all") % buckets
    wide = more * (small + 1)  # the first `more` buckets hold one row more
    bucket = F.when(rank < wide, F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - wide) / F.greatest(small, F.lit(1)))) + 1
    return ranked.withColumn("bucket", bucket.cast("bigint")).groupBy("bucket").agg(F.min(column).alias("mi"), F.max(column).alias("ma"), F.count(F.lit(1)).alias("cnt"), F.count_distinct(column).alias("ndv"))


def selectivity(histogram: list[dict], op: str, value: float) -> float:
    """Estimated share of rows for `column op value` from collected buckets (a few rows); op: = < >.

    Within the bucket that holds the value, equality takes 1/ndv of it and an inequality half of it.
    """
    total = sum(b["cnt"] for b in histogram)
    if not total:
        return 0.0
    inside = [b for b in histogram if b["mi"] <= value <= b["ma"]]
    if op == "=":
        return sum(b["cnt"] / max(b["ndv"], 1) for b in inside[:1]) / total
    below = sum(b["cnt"] for b in histogram if b["ma"] < value) + 0.5 * sum(b["cnt"] for b in inside)
    if op == "<":
        return below / total
    if op == ">":
        return 1 - below / total
    raise ValueError(f"unknown operator {op}")


def distinct_sketch(df: DataFrame, column: str, lg_k: int = 12) -> DataFrame:
    """A mergeable HyperLogLog sketch of the column; union with hll_union_agg, read with hll_sketch_estimate."""
    return df.agg(F.hll_sketch_agg(column, lg_k).alias("sketch"))
