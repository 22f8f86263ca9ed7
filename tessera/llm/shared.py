"""What the operators share: tables in the shared folder, Arrow batches in slices, rows grouped from a sorted stream."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import drop, kept_tables, save, shared_folder

__all__ = ["beside", "documents", "drop", "fixed", "groups", "kept_tables", "map_arrow", "record", "save", "shared_folder", "slices", "small", "trim"]

#: Bytes of text that one call of a kernel takes, so that its temporaries stay small whatever the batch.
SLICE_BYTES = 2_000_000


#: Bytes of a saved table that may be sent to every task; in memory it takes several times that.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """A saved table, marked for broadcast if its files are within BROADCAST_BYTES; a larger one is joined by shuffles."""
    spark, path = df.sparkSession, df._tessera_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def beside(texts: DataFrame, table: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """texts joined with a table that grows like them, by shuffles of both at every size: a small input takes no other way than a large one."""
    return texts.join(table.hint("merge"), on, how)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id (bigint), text (NULL as empty) and further named columns, whatever else the table holds."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch with about `limit` bytes of the column each; a longer text makes its own part."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)))
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text") -> DataFrame:
    """f maps a slice of rows to output columns (name -> array or list); schema is the output's DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = f(part)
                yield record(out, arrow)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """At a task's end: give memory that the process has freed back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def record(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    """A batch of the schema's types from arrays or lists."""
    made = []
    for field in arrow:
        v = columns[field.name]
        if not isinstance(v, pa.Array):
            v = pa.array(v, type=field.type, from_pandas=False)
        made.append(v if v.type == field.type else v.cast(field.type))
    return pa.RecordBatch.from_arrays(made, schema=arrow)


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of neighbouring rows with equal (non-null bigint) keys, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(c)) for c in keys], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def fixed(rng: int, n: int) -> np.ndarray:
    """n random odd 64-bit constants from a seed: the same on every executor."""
    return np.random.Generator(np.random.PCG64(rng)).integers(0, 2**64, n, dtype=np.uint64, endpoint=False) | np.uint64(1)
