"""Exact links of a similarity graph inside candidate groups, without all pairs.

A group is bounded work for one task, or is cut into blocks. Inside a block a breadth-first search compares a found
member with the rows not found yet only: a dense group is linked by a spanning tree after few comparisons. Blocks of a
large group share a few leaders, which joins nearly all of a dense group in one round whose work is in proportion to
its rows. Only rows outside the group's largest component then meet all blocks, so no link between different
components is lost, and rows are copied as often as the rest fills blocks, not as the group does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import groups, save, small

#: Elements of sets that one block holds; a task works on two blocks at most.
BLOCK_ELEMENTS = 50_000
#: Rows that all blocks of a large group share.
LEADERS = 4

Pairs = list[tuple[int, int]]


def block_pairs(members: DataFrame, key: str | list[str], ident: str, weight: str, limit: int) -> DataFrame:
    """Adds own (the row's block) and i, j: the pairs of blocks of its group that the row takes part in, so that all rows of a group meet.

    A group within the limit is the one block (0, 0). Only sums for each group are gathered; hot groups are dealt out.
    """
    # written, so that both sides of the join are plain exchanges, whose hot keys adaptive joins can split
    sums = save(members.groupBy(key).agg(F.ceil(F.sum(weight) / limit).cast("int").alias("__blocks")), "sums")
    rows = members.join(sums, key).withColumn("own", F.pmod(F.xxhash64(ident), F.greatest("__blocks", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("__blocks") - 1, F.lit(0)))).alias("__other")
    out = rows.select("*", other)
    return out.withColumns({"i": F.least("own", "__other"), "j": F.greatest("own", "__other")}).drop("__blocks", "__other")


def linked_pairs(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links sets with 100 * intersection >= percent * union; empty sets link with none."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    if n <= 6:
        out, root = [], list(range(n))
        for x in range(n):
            for y in range(x):
                a, b = sizes[x], sizes[y]
                if root[x] != root[y] and min(a, b) and 100 * min(a, b) >= percent * max(a, b):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (a + b - both):
                        out.append((x, y))
                        old, new = root[x], root[y]
                        root = [new if r == old else r for r in root]
        return out
    flat = np.concatenate(sets)
    _, code = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    by_code = np.argsort(code, kind="stable")
    df = np.bincount(code)
    held = np.concatenate([[0], np.cumsum(df)])
    left = sizes > 0
    posts, posts_at = owner[by_code], held
    alive, rebuilt = int(left.sum()), n
    out = []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            alive = int(left.sum())
            if not alive:
                break
            if alive < rebuilt // 2:  # postings of found rows are of no more use
                keep = left[posts]
                posts_at = np.concatenate([[0], np.cumsum(keep)])[posts_at]
                posts, rebuilt = posts[keep], alive
            codes = code[first[x] : first[x + 1]]
            a, k = posts_at[codes], posts_at[codes + 1] - posts_at[codes]
            total = int(k.sum())
            if not total:
                continue
            places = np.arange(total) - np.repeat(np.cumsum(k) - k, k) + np.repeat(a, k)
            both = np.bincount(posts[places], minlength=n)
            hit = np.flatnonzero(left & (both > 0) & (100 * both >= percent * (sizes[x] + sizes - both)))
            left[hit] = False
            queue.extend(hit.tolist())
            out.extend((x, y) for y in hit.tolist())
    return out


def in_blocks(rows: DataFrame, keys: Sequence[str], connect: Callable[[pa.Table], Pairs]) -> DataFrame:
    """Links (a, b) by id that connect() gives, as places, for each group of rows with equal keys (all bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, keys):
            ids, first = np.unique(np.asarray(group.column("id").combine_chunks()), return_index=True)
            if len(ids) < 2:
                continue
            links = connect(group.take(pa.array(first)) if len(first) < group.num_rows else group)
            if links:
                ids = ids if len(first) < group.num_rows else np.asarray(group.column("id").combine_chunks())
                x, y = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], ["a", "b"])

    typed = rows.select(*[F.col(c).cast("bigint").alias(c) if c in keys else F.col(c) for c in rows.columns])
    return typed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def spanning_links(rows: DataFrame, keys: Sequence[str], limit: int, connect: Callable[[pa.Table], Pairs]) -> DataFrame:
    """Links (a, b) that connect, in each group of equal keys, all rows that links connect.

    rows (written): keys, id (bigint), n (weight) and what connect() reads. connect() finds such links in one block; a
    task holds two blocks of weight `limit` at most, or one heavier row with another.
    """
    sizes = rows.groupBy(*keys).agg(F.sum("n").alias("__size")).where(F.col("__size") > limit)
    large = save(sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("__size") / limit).cast("int").alias("__blocks")), "large")
    if large.isEmpty():
        return in_blocks(rows, keys, connect)
    columns = rows.columns

    def of(table: DataFrame, how: str = "inner") -> DataFrame:
        same = [rows[k] == F.col(f"__{k}") for k in keys]
        return rows.join(small(table), same, how)

    parts = save(of(large).select(*columns, "__blocks", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("__blocks")).cast("bigint").alias("i")), "parts")
    least = parts.groupBy(*keys, F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(LEADERS))).agg(F.min(F.struct(F.xxhash64(F.lit(7), "id"), "id")).alias("m"))
    leaders = save(least.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("m.id").alias("__leader")), "leaders")
    of_leaders = parts.join(small(leaders), [*[parts[k] == F.col(f"__{k}") for k in keys], parts["id"] == F.col("__leader")], "left_semi")
    everywhere = of_leaders.select(*columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks").cast("bigint") - 1)).alias("i"))
    first = save(in_blocks(parts.select(*columns, "i").unionByName(everywhere), [*keys, "i"], connect), "links")

    # rows outside their group's largest component meet all blocks
    found = components(first).select(F.col("id").alias("__node"), "component")
    placed = parts.select(*keys, "id", "n").join(found, F.col("id") == F.col("__node"), "left").select(*keys, "id", "n", F.coalesce("component", "id").alias("c"))
    placed = save(placed, "placed")
    counts = placed.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("rows"))
    main = save(counts.groupBy(*keys).agg(F.max_by("c", F.struct("rows", "c")).alias("__main")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__main"), "main")
    rest = placed.join(small(main), [placed[k] == F.col(f"__{k}") for k in keys]).where("c <> __main").select(*keys, "id", "n")
    rest = save(rest.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("id").alias("__rest"), F.col("n").alias("__n")), "rest")
    whole = of(large, "left_anti")
    out = in_blocks(whole, keys, connect).unionByName(first)
    if rest.isEmpty():
        return out
    shares = save(rest.groupBy(*[f"__{k}" for k in keys]).agg(F.ceil(F.sum("__n") / limit).cast("bigint").alias("__shares")), "shares")
    in_group = [parts[k] == F.col(f"__{k}") for k in keys]
    every = parts.join(small(shares), in_group).select(*columns, "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__shares") - 1)).alias("k"))
    lone = parts.join(small(rest), [*in_group, parts["id"] == F.col("__rest")], "left_semi").join(small(shares), in_group)
    lone = lone.select(*columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks").cast("bigint") - 1)).alias("i"), F.pmod(F.xxhash64(F.lit(8), "id"), F.col("__shares")).alias("k"))
    return out.unionByName(in_blocks(every.unionByName(lone), [*keys, "i", "k"], connect))


def verified_links(rows: DataFrame, percent: int, limit: int = BLOCK_ELEMENTS) -> DataFrame:
    """rows (written): cluster, id, n, elements (n sorted distinct 64-bit hashes as bytes). Spanning links (a, b) by exact set comparison."""

    def connect(table: pa.Table) -> Pairs:
        return linked_pairs([np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("elements").chunks for x in c], percent)

    return spanning_links(rows.select("cluster", "id", "n", "elements"), ["cluster"], limit, connect)
