"""Projection, filter, aggregation, windows and order as plain plan builders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns)


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """Filter: rows whose predicate is true."""
    return df.where(predicate)


AGGREGATES = {
    "count": F.count,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
}


def aggregate(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, str]], having: Column | None = None) -> DataFrame:
    """Hash aggregation, partial and final. wanted: output name -> (function, column or '*').

    Without keys one row comes back even from no input: COUNT 0, the others NULL. Sums of integers are bigint.
    """
    made = []
    for name, (function, column) in wanted.items():
        if function not in AGGREGATES:
            raise ValueError(f"unknown aggregate {function}")
        made.append(AGGREGATES[function](F.lit(1) if column == "*" else F.col(column)).alias(name))
    out = df.groupBy(*keys).agg(*made)
    return out if having is None else out.where(having)


def windowed(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], wanted: Mapping[str, Column]) -> DataFrame:
    """Append window columns. With an order the default frame ends at the current row's peers, else it is the partition."""
    w = Window.partitionBy(*partition)
    w = w.orderBy(*order) if order else w
    return df.select("*", *[c.over(w).alias(name) for name, c in wanted.items()])


def ordered(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Total order by (column, ascending) pairs; a range exchange, then a sort that spills by itself."""
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in keys])


def top(df: DataFrame, keys: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """The first n rows in that order; each task keeps n rows, so nothing is sorted as a whole."""
    return ordered(df, keys).limit(n)
