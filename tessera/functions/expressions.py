"""Expression helpers that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero; anything over zero is 0 (also NULL over zero)."""
    return F.when(b == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", a, b))


def wide(c: Column) -> Column:
    """As bigint, so that int32 products can't overflow under ANSI rules."""
    return c.cast("bigint")
