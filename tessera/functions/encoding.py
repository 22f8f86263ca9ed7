"""Run-length, delta and dictionary encoding of an ordered column, as window plans.

Pass `within` columns to encode segments side by side; without them the order is over all rows (ordering.py): ranges
of it are encoded side by side, and only one carry row a range is put in sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ordering import PART, before, numbered, ranged

CARRY = "__carry"


def _previous(df: DataFrame, value: str, order: str, within: Sequence[str]) -> DataFrame:
    """Adds __prev (the value before, in order) and __first (no row is before)."""
    if within:
        w = Window.partitionBy(*within).orderBy(order)
        return df.withColumns({"__prev": F.lag(value).over(w), "__first": F.row_number().over(w) == 1})
    parts = ranged(df, order)
    last = parts.groupBy(PART).agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias(CARRY))
    carried = last.select(PART, F.lag(CARRY).over(Window.orderBy(PART)).alias(CARRY))  # one row a range
    w = Window.partitionBy(PART).orderBy(order)
    first = F.row_number().over(w) == 1
    return parts.join(F.broadcast(carried), PART).withColumns({"__prev": F.when(first, F.col(CARRY)["v"]).otherwise(F.lag(value).over(w)), "__first": first & F.col(CARRY).isNull()}).drop(CARRY)


def rle_encode(df: DataFrame, value: str, order: str, within: Sequence[str] = ()) -> DataFrame:
    """Runs of equal neighbours: columns within, run_start (order of its first row), val, cnt. NULL equals NULL here."""
    prev = _previous(df, value, order, within)
    starts = prev.withColumn("__new", (F.col("__first") | ~F.col("__prev").eqNullSafe(F.col(value))).cast("int"))
    if within:
        run = F.sum("__new").over(Window.partitionBy(*within).orderBy(order))
        keys = [*within]
    else:
        sums = starts.groupBy(PART).agg(F.sum("__new").alias("__n"))
        base = sums.select(PART, before(sums, "__n").alias("__base"))
        starts = starts.join(F.broadcast(base), PART)
        run = F.col("__base") + F.sum("__new").over(Window.partitionBy(PART).orderBy(order))
        keys = []
    return starts.withColumn("__run", run).groupBy(*keys, "__run").agg(F.min(order).alias("run_start"), F.first(value).alias("val"), F.count(F.lit(1)).alias("cnt")).drop("__run")


#: Rows of a run that one array holds while it is decoded.
CHUNK = 1 << 16


def rle_decode(runs: DataFrame) -> DataFrame:
    """Each val cnt times, with its place in the run from 0: columns run_start, place, val. A long run goes chunk by chunk."""
    chunks = runs.where("cnt > 0").select("run_start", "val", "cnt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cnt").cast("bigint") - 1, F.lit(CHUNK).cast("bigint"))).alias("__at"))
    last = F.least(F.col("cnt").cast("bigint"), F.col("__at") + CHUNK) - 1
    return chunks.select("run_start", F.explode(F.sequence(F.col("__at"), last)).alias("place"), "val")


def delta_encode(df: DataFrame, value: str, order: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds delta: the value less the one before; the first value itself."""
    return _previous(df, value, order, within).withColumn("delta", F.col(value) - F.coalesce(F.col("__prev"), F.lit(0))).drop("__prev", "__first", PART)


def delta_decode(df: DataFrame, delta: str, order: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds value: the running sum of the deltas, of each segment or of all rows."""
    w = Window.partitionBy(*(within or [PART])).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if within:
        return df.withColumn("value", F.sum(delta).over(w))
    parts = ranged(df, order)
    sums = parts.groupBy(PART).agg(F.sum(delta).alias("__sum"))
    base = sums.select(PART, before(sums, "__sum").alias("__base"))  # one row a range
    return parts.join(F.broadcast(base), PART).withColumn("value", F.col("__base") + F.sum(delta).over(w)).drop(PART, "__base")


def dictionary(df: DataFrame, value: str, order: str | None = None) -> DataFrame:
    """Distinct values with codes from 0: by first appearance along order, else sorted. NULL has no code."""
    distinct = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order or value).alias("__at"))
    return numbered(distinct, "__at", value).select(value, F.col("__n").alias("code"))


def dictionary_encode(df: DataFrame, value: str, order: str | None = None) -> DataFrame:
    """Adds code. The distinct values are numbered apart from the rows; Spark broadcasts them if they are few."""
    return df.join(dictionary(df, value, order), value, "left")
