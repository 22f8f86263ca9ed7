"""One total order over all rows without one task that sees them all.

Rows are range-partitioned by the order and written with the number of their range, because two plans read them: one
that sums up each range, and one that needs those sums. Were they dealt out twice, the sampled bounds might differ. Only a
row a range is put in sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import save

PART = "__part"


def ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows with __part, the number of their range, written; equal keys share a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return save(df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def before(sums: DataFrame, column: str) -> Column:
    """Sum of a column over all ranges before this one; for a table of one row a range."""
    return F.coalesce(F.sum(column).over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds __n, the place from 0 in the order, and __all, the number of rows."""
    parts = ranged(df, *order)
    sums = parts.groupBy(PART).agg(F.count(F.lit(1)).alias("__rows"))
    base = sums.select(PART, before(sums, "__rows").alias("__base"), F.sum("__rows").over(Window.partitionBy()).alias("__all"))
    place = F.col("__base") + F.row_number().over(Window.partitionBy(PART).orderBy(*order)) - 1
    return parts.join(F.broadcast(base), PART).withColumn("__n", place).drop(PART, "__base")
