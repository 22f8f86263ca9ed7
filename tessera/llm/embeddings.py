"""Embedding near-duplicates: sign hashes by random hyperplanes in several tables, exact cosine, components.

Equal vectors collapse to one node with a weight. A table hashes a vector to the signs of its products with random
hyperplanes; vectors that share a table's code meet in a bucket. What travels there is a sketch, the signs of SIGNS
further products: pairs whose sketches differ too much for the threshold are left out, the others become candidates,
of which a bucket gives a spanning forest. Components of the candidates get their full vectors, once each; every pair
inside one is verified by cosine in double precision, as matrix products, so the number of links is exact for the
pairs found. A large component is cut into blocks, and each pair of blocks is a task's work. Pairs are never written:
a block gives each vector its number of links and a spanning forest.

The number of bits grows with the logarithm of the rows, which keeps buckets small; the number of tables follows from
it such that a pair at the threshold shares no bucket with a chance of MISS at most; the sketch adds SCREENED to it.
Vectors that are NULL, zero, or hold NULL, NaN or infinite components link with nothing, and vectors of different
lengths never link. A row is a vector: rows that repeat a vec_id are linked by their own vectors and answered each. A
row without an id links with nothing and is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import groups, kept_tables, save, small
from tessera.llm.similar import Pairs, block_pairs, spanning_links
from tessera.llm.words import mix

#: Chance that a pair at the threshold shares no bucket, and that its sketches differ too much; rows of a bucket aimed
#: at; signs of a sketch; rows of one block of a bucket or component.
MISS, SCREENED, BUCKET, SIGNS, BLOCK = 0.002, 0.0005, 512, 256, 2048


def shape(rows: int, threshold: float) -> tuple[int, int]:
    """Bits a code and number of tables for so many distinct vectors."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(60, max(4, round(math.log2(max(rows, 1) / BUCKET)))) if rows > BUCKET else 4
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same**bits)))


def most_apart(threshold: float) -> int:
    """Signs in which the sketches of a pair at the threshold differ, but for a chance of SCREENED (binomial)."""
    p, left, k = math.acos(threshold) / math.pi, 1.0, -1
    while left > SCREENED:
        k += 1
        left -= math.comb(SIGNS, k) * p**k * (1 - p) ** (SIGNS - k)
    return k


def signs(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Of each vector's products with n hyperplanes, which depend on the seed and the vectors' length only."""
    planes = np.random.Generator(np.random.PCG64([x.shape[1], seed])).standard_normal((x.shape[1], n))
    return x @ planes >= 0


def codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One row a vector of a code for each table."""
    return (signs(x, tables * bits, 1).reshape(len(x), tables, bits) << np.arange(bits, dtype=np.int64)).sum(2)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of each length."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    sizes, flat, at = np.diff(offsets), np.asarray(column.flatten()).astype(np.float64), offsets[:-1] - offsets[0]
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        yield own, unit(flat[at[own][:, None] + np.arange(d)])


def near(sketches: np.ndarray, apart: int) -> np.ndarray:
    """Boolean matrix of the pairs whose sketches (bytes) differ in at most so many signs."""
    x = np.unpackbits(sketches, axis=1).astype(np.float32) * 2 - 1
    g = x @ x.T >= sketches.shape[1] * 8 - 2 * apart
    np.fill_diagonal(g, False)
    return g


def spanning(adjacent: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of a boolean adjacency matrix, by breadth-first search."""
    left = np.ones(len(adjacent), bool)
    a, b = [], []
    for seed in np.flatnonzero(adjacent.any(1)).tolist():
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            hit = np.flatnonzero(adjacent[x] & left).tolist()
            left[hit] = False
            queue += hit
            a += [x] * len(hit)
            b += hit
    return a, b


def verified(x: np.ndarray, weight: np.ndarray, own: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, list[int], list[int]]:
    """Weighted link counts and a spanning forest of one block (own all equal) or between two blocks."""
    g = np.empty((len(x), len(x)), bool)
    for a in range(0, len(x), 512):
        np.greater_equal(x[a : a + 512] @ x.T, threshold, out=g[a : a + 512])
    np.fill_diagonal(g, False)
    if across:
        g &= own[:, None] != own[None, :]
    counts = np.fromiter((weight[r].sum() for r in g), np.int64, len(g))
    return counts, *spanning(g)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    given = F.col(vector_column)
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), given.alias("v"))
    ends = F.exists("v", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    usable = F.coalesce(F.size("v") > 0, F.lit(False)) & ~ends & F.exists("v", lambda c: c != 0)
    keyed = rows.withColumns({"ok": F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull(), "d": F.col("v").cast("array<double>")})
    keyed = keyed.select("vec_id", "v", "ok", F.xxhash64("d").alias("f1"), F.xxhash64(F.lit(7), "d").alias("f2"))
    with kept_tables(vectors.sparkSession) as tables:
        answers = answered(keyed.where("ok"), threshold)
        tables.keep(answers)
    usable_rows = keyed.select("vec_id", F.when(F.col("ok"), F.col("f1")).alias("f1"), F.when(F.col("ok"), F.col("f2")).alias("f2"))
    out = usable_rows.join(answers, ["f1", "f2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def answered(keyed: DataFrame, threshold: float) -> DataFrame:
    """keyed: vec_id, v, and its fingerprint f1, f2. n_links and component_id of each fingerprint, written."""
    some = keyed.groupBy("f1", "f2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    nodes = save(some.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "id", "w", "v"), "vectors")
    bits, tables = shape(nodes.count(), threshold)
    apart = most_apart(threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets: list = [None] * batch.num_rows
            sketches: list = [None] * batch.num_rows
            for own, x in by_length(batch.column("v")):
                key = mix(mix(codes(x, bits, tables).astype(np.uint64) + np.uint64(x.shape[1] << 32)) ^ mix(np.arange(1, tables + 1, dtype=np.uint64))).view(np.int64)
                sketch = np.packbits(signs(x, SIGNS, 2), axis=1)
                for i, k, b in zip(own.tolist(), key, sketch, strict=True):
                    buckets[i], sketches[i] = k, b.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(buckets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "buckets", "sketch"])

    def connect(table: pa.Table) -> Pairs:
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        return list(zip(*spanning(near(sketch, apart)), strict=True))

    signed = save(nodes.select("node", "v").mapInArrow(hashed, "id bigint, buckets array<bigint>, sketch binary"), "signed")
    members = signed.select(F.explode("buckets").alias("bucket"), "id", F.lit(1).alias("n"), "sketch")
    candidates = components(spanning_links(members, ["bucket"], BLOCK, connect))

    clusters = save(candidates.select(F.col("id").alias("a"), F.col("component").alias("cluster")), "clusters")
    found = nodes.join(small(clusters), F.col("node") == F.col("a")).select("cluster", "node", "w", "v", F.lit(1).alias("one"))
    pairs = block_pairs(save(found, "members"), "cluster", "node", "one", BLOCK)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("cluster", "i", "j")):
            if group.num_rows < 2:
                continue
            ids, weight, own = (np.asarray(group.column(c).combine_chunks()) for c in ("node", "w", "own"))
            for at, x in by_length(group.column("v").combine_chunks()):
                n, a, b = verified(x, weight[at], own[at], group.column("i")[0].as_py() != group.column("j")[0].as_py(), threshold)
                hit, mine = np.flatnonzero(n), ids[at]
                if len(hit):
                    nothing = np.full(len(hit), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([mine[hit], mine[a]])), pa.array(np.concatenate([nothing, mine[b]])), pa.array(np.concatenate([n[hit], np.zeros(len(a), np.int64)]).astype(np.int64))], ["a", "b", "n"])

    blocks = pairs.select("cluster", F.col("i").cast("bigint"), F.col("j").cast("bigint"), "node", "w", "v", F.col("own").cast("bigint"))
    links = save(blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(linked, "a bigint, b bigint, n bigint"), "links")
    classes = components(links.where("n = 0"))
    counts = save(links.groupBy("a").agg(F.sum("n").alias("n")), "counts")
    classed = nodes.select("node", "f1", "f2", "id", "w").join(classes.withColumnRenamed("id", "c_node"), F.col("node") == F.col("c_node"), "left")
    classed = save(classed.select("node", "f1", "f2", "id", "w", F.coalesce("component", "node").alias("component")), "classed")
    least = save(classed.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    answers = classed.join(least, "component").join(counts, F.col("node") == F.col("a"), "left")
    return save(answers.select("f1", "f2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id"), "answers")
