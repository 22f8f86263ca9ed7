"""MinHash near-duplicates of whole texts by an LSH forest, every link confirmed on full shingle sets.

1. Each text becomes its set of distinct k-word shingles; equal sets (128-bit fingerprints) collapse to one row.
2. Every set has 16 labels of eight minima. In 16 sorted orders of the labels, rows that share a prefix of four
   minima form a region; all its rows are compared, those of a large region by pairs of blocks in many tasks. A sketch
   of 64 bytes screens out rows that cannot reach the threshold.
3. Components of the screened candidates get their full sets, once each, and are searched exactly (similar.py).

A pair at the threshold of 0.8 shares a prefix of four in one of 16 orders with a chance of 0.9998, and the screen
(an estimate of 0.55 or more, five standard errors below 0.8) passes it but for one case in a million. Nulls and texts
without words have the empty set and link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import beside, documents, fixed, kept_tables, map_arrow, save, small
from tessera.llm.similar import BLOCK_ELEMENTS, spanning_links, verified_links
from tessera.llm.words import U, Words, mix, words

TREES, DEPTH, PREFIX, SKETCH = 16, 8, 4, 64
#: Rows of a region, or of a block of it, that are compared by sketch in one go; every two blocks of a larger region meet.
REGION = 16_384
#: Least share of equal sketch bytes: similarity 0.55 and the chance matches of bytes.
SCREEN = int(SKETCH * (0.55 + 0.45 / 256)) + 1
FLIPS = (fixed(21, TREES * DEPTH) >> U(32)).astype(np.uint32)
FACTORS = fixed(22, TREES * DEPTH).astype(np.uint32)
#: Elements whose minima are taken at once.
CHUNK = 1 << 18


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text with fewer than k words has its whole sequence as one."""
    hashes, inside = w.windows(k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(hashes[a : b - k + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in w.hashes[a:b]:
                whole = mix(np.atleast_1d(h ^ mix(np.atleast_1d(whole))))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over the elements of each set."""
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    for i, s in enumerate(sets):
        one[i] = mix(s).sum(dtype=np.uint64)
        two[i] = mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + U(len(s))
    return one.view(np.int64), two.view(np.int64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row a set of TREES * DEPTH minima (uint32); rows of empty sets hold the largest value."""
    out = np.full((len(sets), TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        to, n = at, 0
        while to < len(full) and (to == at or n + len(sets[full[to]]) <= CHUNK):
            n += len(sets[full[to]])
            to += 1
        own = full[at:to]
        x = (np.concatenate([sets[i] for i in own]) >> U(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in own])[:-1]])
        y = np.empty_like(x)
        for p in range(TREES * DEPTH):
            np.bitwise_xor(x, FLIPS[p], out=y)
            np.multiply(y, FACTORS[p], out=y)
            out[own, p] = np.minimum.reduceat(y, starts)
        at = to
    return out


def signature_columns(sets: list[np.ndarray]) -> dict:
    m = minima(sets)
    scrambled = mix(m.astype(np.uint64) + (np.arange(TREES * DEPTH, dtype=np.uint64) << U(32)))
    labels = (scrambled & U(0xFFFF)).astype(np.int64).reshape(len(sets), TREES, 2, DEPTH // 2)
    labels = labels[..., 0] << 48 | labels[..., 1] << 32 | labels[..., 2] << 16 | labels[..., 3]
    sketch = (scrambled[:, :: TREES * DEPTH // SKETCH] >> U(40)).astype(np.uint8)
    flat = pa.array(labels.reshape(-1))
    offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TREES * 2)
    return {"labels": pa.ListArray.from_arrays(offsets, flat), "sketch": [x.tobytes() for x in sketch]}


def alike(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Which sketches pass the screen against one."""
    same = np.ascontiguousarray(sketches == one).view(np.uint64).sum(1, dtype=np.uint64)  # eight counts side by side
    return (same * U(0x0101010101010101)) >> U(56) >= U(SCREEN)


def search(rows: list[tuple[int, int]], labels: np.ndarray, sketch: np.ndarray, ids: np.ndarray, out: list) -> None:
    """Candidate links that connect in each region (first, end) all rows whose sketches pass the screen; labels, the rows' order, make no difference."""
    for a, b in rows:
        left, own = np.arange(a, b), sketch[a:b]
        while len(left) > 1:
            queue, left, own = [left[0]], left[1:], own[1:]
            while queue and len(left):
                seed = queue.pop()
                near = alike(own, sketch[seed])
                if near.any():
                    found = left[near].tolist()
                    left, own = left[~near], own[~near]
                    queue.extend(found)
                    out.extend((ids[seed], ids[f]) for f in found)


def table_links(table: pa.Table, rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidate links in regions of a table with id and sketch."""
    n, raw = table.num_rows, table["sketch"].combine_chunks()
    size = np.frombuffer(raw.buffers()[1], np.int32, n + 1, raw.offset * 4)
    sketch = np.frombuffer(raw.buffers()[2], np.uint8)[size[0] : size[-1]].reshape(n, SKETCH)
    ids, found = np.asarray(table["id"].combine_chunks()), []
    search(rows, np.zeros(n, np.int64), sketch, ids, found)
    return found


def forest_candidates(reps: DataFrame) -> DataFrame:
    """reps: id, labels, sketch. Links (a, b) that connect all rows that share a region and pass the screen.

    A region that lies inside a task and has at most REGION rows is compared at once. Of all others (too large, or cut
    by a task's end) only the label is noted; their rows are then dealt out in blocks (spanning_links).
    """
    limit = REGION
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    orders = reps.select("id", tree, "labels", "sketch").select("tree", F.expr("labels[2 * tree]").alias("p"), "id", "sketch")

    def batch_of(kind: bool, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        x, y = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind)), pa.array(x), pa.array(y)], ["noted", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        key = None
        noted: set[tuple[int, int]] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, part]).combine_chunks() if held is not None else part
            tree, p = np.asarray(table["tree"].combine_chunks()), np.asarray(table["p"].combine_chunks())
            if key is None:
                noted.add((int(tree[0]), int(p[0])))
            cuts = [0, *(np.flatnonzero((tree[1:] != tree[:-1]) | (p[1:] != p[:-1])) + 1).tolist(), len(tree)]
            key = int(tree[-1]), int(p[-1])
            regions = []
            for x, y in zip(cuts[:-2], cuts[1:-1], strict=True):
                own = int(tree[x]), int(p[x])
                if y - x > limit:
                    noted.add(own)
                elif y - x > 1 and own not in noted:
                    regions.append((x, y))
            if regions:
                yield batch_of(False, table_links(table, regions))
            # the last region may go on; of one that is noted anyway a row will do
            if len(tree) - cuts[-2] > limit:
                noted.add(key)
            held = table.slice(cuts[-2], 1) if key in noted else table.slice(cuts[-2])
        if key is not None:
            noted.add(key)
            yield batch_of(True, sorted(noted))

    def connect(table: pa.Table) -> list[tuple[int, int]]:
        n = table.num_rows
        return table_links(table.select(["sketch"]).append_column("id", pa.array(np.arange(n))), [(0, n)])

    # ids break ties of the order, so that even one label's rows are dealt to many tasks
    found = orders.repartitionByRange("tree", "p", "id").sortWithinPartitions("tree", "p", "id").mapInArrow(run, "noted boolean, a bigint, b bigint")
    found = save(found, "found")
    noted = save(found.where("noted").select(F.col("a").cast("int").alias("tree"), F.col("b").alias("p")).distinct(), "noted")
    rows = save(orders.join(small(noted), ["tree", "p"]).select(F.col("tree").cast("bigint").alias("tree"), "p", "id", F.lit(1).alias("n"), "sketch"), "regions")
    return found.where("NOT noted").select("a", "b").unionByName(spanning_links(rows, ["tree", "p"], limit, connect))


def content(text_column: str = "text"):
    """A checksum of a row's text: with its id it tells rows apart that repeat an id."""
    return F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))


def classified(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Returns (rows, classes), both written.

    rows: doc_id, content, n_shingles and the set's fingerprint f1, f2 of each row. classes: for each fingerprint of a
    set that is not empty the number of its component, and the component's least row (least_id, least_content).
    The nodes of the graph are the sets themselves under numbers of their own, so rows that repeat an id stay apart.
    """
    with kept_tables(docs.sparkSession) as tables:
        rows, classes = _classified(docs.withColumn("content", content()), shingle, percent)
        tables.keep(rows, classes)
    return rows.select("doc_id", "content", "n_shingles", "f1", "f2"), classes


def _classified(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    def sign(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(words(part.column("text"), lower=True), shingle)
        one, two = fingerprints(sets)
        return {"doc_id": part.column("doc_id"), "content": part.column("content"), "n_shingles": [len(s) for s in sets], "f1": one, "f2": two} | signature_columns(sets)

    signed = save(map_arrow(docs, sign, "doc_id bigint, content bigint, n_shingles bigint, f1 bigint, f2 bigint, labels array<bigint>, sketch binary"), "signed")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # written, so that both sides of a join are plain exchanges, whose hot keys adaptive joins can split
    sets = some.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "content")).alias("m"))
    sets = save(sets.select("f1", "f2", F.col("m.doc_id").alias("id"), F.col("m.content").alias("id_content"), F.monotonically_increasing_id().alias("node")), "sets")
    known = sets.withColumnsRenamed({"f1": "g1", "f2": "g2"})
    of_least = (F.col("doc_id") == F.col("id")) & (F.col("content") == F.col("id_content")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))
    reps = some.join(known, of_least).groupBy("node").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("id", "id_content", "n_shingles", "labels", "sketch")])
    reps = save(reps, "reps")
    candidates = components(forest_candidates(reps.select(F.col("node").alias("id"), "labels", "sketch")))
    clusters = candidates.select(F.col("id").alias("node"), F.col("component").alias("cluster")).join(reps.drop("labels", "sketch"), "node")
    wanted = save(clusters, "wanted")

    def elements(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(words(part.column("text"), lower=True), shingle)
        return {"cluster": part.column("cluster"), "id": part.column("node"), "n": [len(s) for s in sets], "elements": [s.tobytes() for s in sets]}

    texts = beside(docs, wanted, (F.col("doc_id") == F.col("id")) & (F.col("content") == F.col("id_content"))).select("node", "cluster", "text")
    if not wanted.where("copies > 1").isEmpty():  # rows that repeat id and text
        texts = texts.dropDuplicates(["node"])
    rows = map_arrow(texts, elements, "cluster bigint, id bigint, n bigint, elements binary")
    found = components(verified_links(save(rows, "elements"), percent, BLOCK_ELEMENTS))
    nodes = sets.join(found.withColumnRenamed("id", "linked"), F.col("node") == F.col("linked"), "left")
    nodes = save(nodes.select("f1", "f2", "id", "id_content", F.coalesce("component", "node").alias("component")), "nodes")
    least = save(nodes.groupBy("component").agg(F.min(F.struct("id", "id_content")).alias("m")).select("component", F.col("m.id").alias("least_id"), F.col("m.id_content").alias("least_content")), "least")
    classes = save(nodes.select("f1", "f2", "component").join(least, "component"), "classes")
    return signed, classes


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: components of similarity percent / 100 or more of lower-cased k-word shingles.

    component_id is the least doc_id reachable. Rows that repeat a doc_id are linked by their own texts and answered
    each. A row without an id, or without words, links with nothing: its own id is its component, and it is kept. An
    empty table gives none.
    """
    rows, classes = classified(documents(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))), shingle, percent)
    rows = rows.join(classes, ["f1", "f2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows and columns of docs without those that near-duplicate one of less (doc_id, checksum of the text).

    Of rows that repeat id and text one stays. Rows without an id or without words all stay.
    """
    rows, classes = classified(documents(docs), shingle, percent)
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = (F.col("doc_id") == F.col("least_id")) & (F.col("content") == F.col("least_content"))
    gone = some.join(classes, ["f1", "f2"]).where(~least).select("doc_id", "content").distinct()
    again = some.groupBy("doc_id", "content").count().where("count > 1").select("doc_id", "content")
    gone, again = (save(x.select(F.col("doc_id").alias("__gone"), F.col("content").alias("__content")), n) for x, n in ((gone, "gone"), (again, "again")))
    same = (F.col("doc_id").cast("bigint") == F.col("__gone")) & (content() == F.col("__content"))
    rest = beside(docs, gone, same, "left_anti")
    if again.isEmpty():
        return rest
    once = beside(rest, again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return beside(rest, again, same, "left_anti").unionByName(once)
