"""Dot products of all rows with a query set: as many as pairs, so they are taken in columns, not by an expression a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.operators.joins import grid

#: Query rows of a block, which a task holds; pairs of a part with a block, and of one batch out.
BLOCK, PAIRS, SLAB = 2048, 1 << 22, 1 << 15


def vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and components (double) of the vectors of each length. NULL vectors, and those that hold NULL, are left out."""
    ends = np.asarray(column.offsets)
    inside = column.values.slice(ends[0], ends[-1] - ends[0])  # a slice's values are those of its whole batch
    ends = ends - ends[0]
    usable = np.asarray(column.is_valid())
    if inside.null_count:
        gaps = np.concatenate([[0], np.cumsum(np.asarray(inside.is_null()))])
        usable &= gaps[ends[1:]] == gaps[ends[:-1]]
    flat = pc.cast(inside, pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for size in np.unique(sizes[usable]).tolist():
        at = np.flatnonzero(usable & (sizes == size))
        yield at, flat[ends[at][:, None] + np.arange(size)]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each row of x with each column of y. Sums run from the first component on, as in SQL: a matrix product's order gives other last bits."""
    out = np.zeros((len(x), y.shape[1]))
    term = np.empty_like(out)
    with np.errstate(all="ignore"):
        for k in range(x.shape[1]):
            np.multiply(x[:, k : k + 1], y[k], out=term)
            out += term
    return out


class Block:
    """The query rows of one block: ids, and components by length."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.ids = table.column("a_id").combine_chunks()
        self.known = {x.shape[1]: (at, np.ascontiguousarray(x.T)) for at, x in vectors(table.column("v").combine_chunks())}

    def meet(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """All pairs with the rows, b_id, a_id and dot; NULL where there is no product."""
        q = len(self.ids)
        slab = max(1, SLAB // q)
        for start in range(0, rows.num_rows, slab):
            part = rows.slice(start, slab)
            n = part.num_rows
            dot, none = None, np.ones((n, q), bool)
            for at, x in vectors(part.column("v")):
                to, y = self.known.get(x.shape[1], (at[:0], None))
                if len(at) == n and len(to) == q:
                    dot, none = products(x, y), None
                elif len(to):
                    dot = np.zeros((n, q)) if dot is None else dot
                    dot[np.ix_(at, to)], none[np.ix_(at, to)] = products(x, y), False
            dot = np.zeros((n, q)) if dot is None else dot
            pair = [part.column("b_id").take(pa.array(np.repeat(np.arange(n), q))), self.ids.take(pa.array(np.tile(np.arange(q), n)))]
            yield pa.RecordBatch.from_arrays([*pair, pa.array(dot.ravel(), mask=None if none is None else none.ravel())], ["b_id", "a_id", "dot"])


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by part and block, query rows first: each block with the rows that follow it."""
    place, held, block = None, [], None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(c)) for c in ("__part", "__block", "__side")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if start == end:
                continue
            rows, (part, number, side) = batch.slice(start, end - start), keys[:, start].tolist()
            if place != (part, number):
                place, held, block = (part, number), [], None
            if side == 0:
                held.append(rows)
            elif held or block:
                if block is None:
                    block, held = Block(held), []
                yield from block.meet(rows)


def dots(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row with every query row: b_id of the row, a_id of the query, dot in double precision.

    Both hold an id and an array of one type, in this order. dot is NULL where functions.vectors.dot is, and equals it to the last bit.
    """
    (b, v), (a, w) = rows.columns, queries.columns
    dealt, asked, tasks = grid(rows, queries, BLOCK, PAIRS)
    schema = StructType([StructField("b_id", rows.schema[b].dataType), StructField("a_id", queries.schema[a].dataType), StructField("dot", DoubleType())])
    where = ["__part", "__block", "__side"]
    first = asked.select("__part", "__block", F.lit(0).alias("__side"), F.col(a).alias("a_id"), F.lit(None).cast(schema["b_id"].dataType).alias("b_id"), F.col(w).alias("v"))
    then = dealt.select("__part", "__block", F.lit(1).alias("__side"), F.lit(None).cast(schema["a_id"].dataType).alias("a_id"), F.col(b).alias("b_id"), F.col(v).alias("v"))
    return first.unionByName(then).repartition(tasks, "__part", "__block").sortWithinPartitions(*where).mapInArrow(meetings, schema)
