"""Joins. The physical kind is left to Catalyst and adaptive execution; a hint states a wish, never a promise of size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name of a strategy -> Spark's hint.
STRATEGIES = {
    "hash": "shuffle_hash",
    "merge": "merge",
    "broadcast": "broadcast",
    "nested_loop": "shuffle_replicate_nl",
}


#: Bytes of a side that may be sent to every task.
BROADCAST_BYTES = 64 << 20

#: Pairs of rows, and rows, that make a task's work where few small rows have many partners; a key's right rows that meet
#: a left row in one task; keys sent to every task.
PAIRS, ROWS, WIDE, KEYS = 1 << 24, 1 << 20, 1 << 16, 1 << 16


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate for the rows; very large where it knows nothing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """Every conjunct of the condition holds, and the join type is honoured. Left columns come first.

    A broadcast is asked for only if the right side is estimated within BROADCAST_BYTES; beyond it the choice is Spark's.
    """
    if strategy == "broadcast" and estimated_bytes(right) > BROADCAST_BYTES:
        strategy = None
    if strategy is not None:
        right = right.hint(STRATEGIES[strategy])
    return left.join(right, on, how)


def above(left: DataFrame, right: DataFrame, key: tuple[str, str], value: tuple[str, str], block: int = 256) -> DataFrame:
    """Inner join where the keys are equal and the left value is greater. Columns must differ by name; left ones come first.

    The rows out can outgrow both sides by far, which neither a table's files nor its bytes tell. So a key's right rows,
    sorted by value, are cut in chunks of WIDE rows, and its left rows are dealt out in parts that make PAIRS pairs with a
    chunk. Where a part meets a chunk, its rows stream past blocks, of which those that begin above a row's value are not
    opened. The sort of one key's right rows is one task's, which spills; nothing else grows with a key.
    """
    left, right = (t.where(F.col(k).isNotNull() & F.col(v).isNotNull()) for t, k, v in zip((left, right), key, value, strict=True))
    counts = [t.groupBy(F.col(k).alias("__key")).agg(F.count(F.lit(1)).cast("double").alias(n)) for t, k, n in zip((left, right), key, ("__l", "__r"), strict=True)]
    sizes = counts[0].join(counts[1], "__key").withColumns({"__parts": F.ceil(F.col("__l") * F.least("__r", F.lit(float(WIDE))) / PAIRS), "__chunks": F.ceil(F.col("__r") / WIDE)})
    work = F.col("__l") * F.col("__r") / PAIRS + (F.col("__l") * F.col("__chunks") + F.col("__r") * F.col("__parts")) / ROWS
    total = sizes.agg(F.sum(work), F.count(F.lit(1))).first()
    tasks = max(1, math.ceil(total[0] or 0))
    sizes = sizes.select("__key", "__parts", "__chunks")
    if total[1] <= KEYS:
        sizes = F.broadcast(sizes)

    def each(times: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1))

    place = F.row_number().over(Window.partitionBy(key[1]).orderBy(value[1], *right.columns)) - 1
    cut = right.withColumn("__place", place).withColumns({"__c": F.floor(F.col("__place") / WIDE), "__at": F.floor(F.col("__place") % WIDE / block)})
    blocks = cut.groupBy(key[1], "__c", "__at").agg(F.min(value[1]).alias("__least"), F.collect_list(F.struct(*right.columns)).alias("__rows"))
    blocks = blocks.join(sizes, F.col(key[1]) == F.col("__key")).select(F.col("__key").alias("__k"), "__c", "__least", "__rows", each("__parts").alias("__p"))
    dealt = left.join(sizes, F.col(key[0]) == F.col("__key")).select(*left.columns, "__key", F.pmod(F.xxhash64(*left.columns), "__parts").alias("__part"), each("__chunks").alias("__chunk"))
    met = (F.col("__key") == F.col("__k")) & (F.col("__part") == F.col("__p")) & (F.col("__chunk") == F.col("__c")) & (F.col(value[0]) > F.col("__least"))
    opened = dealt.repartition(tasks, "__key", "__part", "__chunk").join(blocks.repartition(tasks, "__k", "__p", "__c").hint("merge"), met)
    return opened.select(*left.columns, F.inline("__rows")).where(F.col(value[0]) > F.col(value[1]))


def grid(rows: DataFrame, queries: DataFrame, block: int, pairs: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides in copies such that a row and a query row meet in one pair of __part and __block, and tasks for the work.

    A block holds about `block` query rows, and a part as many rows as make `pairs` pairs with them, whatever their bytes.
    """
    asked = queries.count()
    held = rows.count()
    blocks = max(1, math.ceil(asked / block))
    parts = max(1, math.ceil(held * min(asked, block) / pairs + held / ROWS))

    def copies(df: DataFrame, own: str, n: int, other: str, times: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint")))
        return df.select("*", F.pmod(F.xxhash64(*df.columns), F.lit(n)).alias(own), each.alias(other))

    tasks = max(1, math.ceil(held * asked / pairs + (held * blocks + asked * parts) / ROWS))
    return copies(rows, "__part", parts, "__block", blocks), copies(queries, "__block", blocks, "__part", parts), tasks


def against(rows: DataFrame, queries: DataFrame, block: int = 1024) -> DataFrame:
    """Every row with every query row, in blocks of queries: a row travels once a block, and each meeting is one generator.

    The work is dealt out by pairs (grid), and both sides travel by shuffles at every size.
    """
    dealt, asked, tasks = grid(rows, queries, block, PAIRS)
    where = ["__part", "__block"]
    blocks = asked.repartition(tasks, *where).groupBy(*where).agg(F.collect_list(F.struct(*queries.columns)).alias("__queries"))
    return dealt.repartition(tasks, *where).join(blocks.hint("merge"), where).select(*rows.columns, F.inline("__queries"))


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cartesian product; for relations of a fixed small size."""
    return left.crossJoin(right)


def keep_in(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """column IN (SELECT key FROM other), as a left semi join."""
    return df.join(other.select(other[key].alias("__key")), df[column] == F.col("__key"), "left_semi")
