"""Repeated passages across documents, by MinHash banding of paragraphs and exact confirmation.

Two kinds of paragraph are banded. Lines of at least PASSAGE words, and, as a passage inside other text has no line of
its own, windows that content itself picks: among every SPREAD neighbouring shingles the one of least hash starts a
window of CUT words, so any PASSAGE words in a row hold such a window, the same one in every copy. Each paragraph's set
of 5-word shingles gives band keys from minima, and paragraphs that share a key are compared.

Lines are confirmed by the exact Jaccard similarity of their sets (similar.py), PERCENT or more. Windows are confirmed
by the text around them at edit distance 0: each brings the hashes of all runs of PASSAGE words whose window it is, and
a run that another document holds too is a repeat. Overlapping runs are merged, so a passage has its exact, longest
ends, and nothing that repeats over fewer words is named.

Of each run the occurrences in the least document stay; all others are removals. Documents that share passages form
components. A document is a row's doc_id with its text: rows that repeat both are one document, rows that repeat only
the id are different ones. Repeats within one document alone are none of this operator's business. Rows without an id
are neither compared nor cut. NULL and empty texts, and those of fewer words, hold no passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.minhash import content
from tessera.llm.shared import beside, documents, drop, fixed, groups, kept_tables, map_arrow, save, slices
from tessera.llm.similar import BLOCK_ELEMENTS, verified_links
from tessera.llm.words import U, Words, mix, words

#: Words of the shortest passage, of a window, and of a shingle; similarity of lines.
PASSAGE, CUT, SHINGLE, PERCENT = 50, 16, 5, 80
#: A window's first shingle is the least of so many neighbours: PASSAGE words in a row hold at least one window.
SPREAD = PASSAGE - CUT + 1
#: Rows of a band of lines, and bands by the recall wanted at the threshold: 1 - (1 - 0.8 ** 3) ** 10 = 0.9992.
ROWS, RECALL = 3, 0.999
BANDS = next(b for b in range(1, 99) if 1 - (1 - (PERCENT / 100) ** ROWS) ** b >= RECALL)
FLIPS, FACTORS = fixed(31, ROWS * BANDS), fixed(32, ROWS * BANDS)
#: A window has one band: copies of a passage hold equal windows, which share it.
CUT_ROWS = 4
#: Windows of one key that are matched at once; more are dealt out in parts, which exchange their distinct runs.
KEY_ROWS = 16_384


def windows_of_runs(w: Words, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all runs of PASSAGE words, and of the window of each: its least shingle (order: their hashes), the last of equals. Both rise."""
    n = len(order)
    runs = n - PASSAGE + 1
    if runs <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, width, at = order, 1, np.arange(n)
    while width * 2 <= SPREAD:  # doubling: least of 2, 4, 8 ... neighbours, with its place
        a, b = low[:-width], low[width:]
        right = b <= a
        low, at, width = np.where(right, b, a), np.where(right, at[width:], at[:-width]), width * 2
    rest = SPREAD - width
    a, b = low[: len(low) - rest], low[rest:]
    at = np.where(b <= a, at[rest:], at[: len(at) - rest])[:runs]
    whole = np.flatnonzero(w.inside(PASSAGE)[:runs])
    return whole, at[whole]


def line_words(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end word of each line of at least PASSAGE words."""
    ends = np.flatnonzero(w.data == 10)
    cuts = np.unique(np.concatenate([w.first, np.searchsorted(w.starts, ends)]))
    a, b = cuts[:-1], cuts[1:]
    long = b - a >= PASSAGE
    a, b = a[long], b[long]
    return np.searchsorted(w.first, a, "right") - 1, a, b


def line_set(shingles: np.ndarray, a: int, b: int) -> np.ndarray:
    return np.unique(shingles[a : b - SHINGLE + 1])


def names(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set."""
    return mix(sums(sets) + np.fromiter(map(len, sets), np.uint64, len(sets))).view(np.int64)


def sums(sets: list[np.ndarray]) -> np.ndarray:
    if not sets:
        return np.zeros(0, np.uint64)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    return np.add.reduceat(mix(np.concatenate(sets)), at)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each (non-empty) set."""
    if not sets:
        return np.zeros((0, BANDS), np.int64)
    x, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), BANDS), np.uint64)
    for i, (f, c) in enumerate(zip(FLIPS, FACTORS, strict=True)):
        least = np.minimum.reduceat((x ^ f) * c, at)
        out[:, i // ROWS] = mix((out[:, i // ROWS] if i % ROWS else np.uint64(i)) ^ least)
    return out.view(np.int64)


def cut_bands(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The band key of the window at each given word."""
    out = np.zeros(len(at), np.uint64)
    for a in range(0, len(at), 16384):
        x = shingles[at[a : a + 16384, None] + np.arange(CUT - SHINGLE + 1)]
        key = np.full(len(x), U(CUT_ROWS))
        for f, c in zip(FLIPS[:CUT_ROWS], FACTORS[:CUT_ROWS], strict=True):
            key = mix(key ^ ((x ^ f) * c).min(1))
        out[a : a + 16384] = key
    return out.view(np.int64)


UNITS = "doc_id bigint, content bigint, at int, key bigint, bands array<bigint>"


def units(docs: DataFrame) -> DataFrame:
    """Windows (key: their band; bands NULL) and long lines (key: a 64-bit name of the set, and its bands) of each text, with their first word."""

    def run(part: pa.RecordBatch) -> dict:
        w = words(part.column("text"))
        shingles, _ = w.windows(SHINGLE)
        s = np.unique(windows_of_runs(w, shingles)[1])
        doc = np.searchsorted(w.first, s, "right") - 1
        text, a, b = line_words(w)
        sets = [line_set(shingles, x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        lists = [None] * len(s) + list(bands(sets))
        owner = np.concatenate([doc, text])
        return {
            "doc_id": np.asarray(part.column("doc_id"))[owner], "content": np.asarray(part.column("content"))[owner],
            "at": np.concatenate([s - w.first[doc], a - w.first[text]]).astype(np.int32),
            "key": np.concatenate([cut_bands(shingles, s), names(sets)]), "bands": pa.array(lists, pa.list_(pa.int64())),
        }

    return map_arrow(docs, run, UNITS)


WINDOW, LINE, LINE_SET = 0, 1, 2
FOUND = "kind int, key bigint, parts int, doc_id bigint, content bigint, at int, stop int, hashes array<bigint>"


def confirm(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: id, id_content, places (array of at, kind, key, parts). For windows the first of the runs whose window
    they are, and the hashes of these runs, which start at one word after the other; for lines their end and, for
    LINE_SET, their set."""

    def run(part: pa.RecordBatch) -> dict:
        w = words(part.column("text"))
        places = part.column("places")
        text = np.repeat(np.arange(len(w)), np.diff(np.asarray(places.offsets)))
        inner = places.flatten()
        place, kind, key = (np.asarray(inner.field(c)) for c in ("at", "kind", "key"))
        at = place + w.first[text]
        shingles = w.windows(SHINGLE)[0]
        starts, window = windows_of_runs(w, shingles)
        hashes = w.rolling(PASSAGE)[starts].view(np.int64)
        inside = kind == WINDOW
        a = np.where(inside, np.searchsorted(window, at), 0)
        sizes = np.where(inside, np.searchsorted(window, at, "right") - a, 0)
        lists: list = [hashes[x : x + n] for x, n in zip(a.tolist(), sizes.tolist(), strict=True)]
        begin, stop = place.copy(), place.copy()
        begin[inside] = starts[a[inside]] - w.first[text[inside]]
        if not inside.all():
            ends = {int(x): int(y) for _, x, y in zip(*line_words(w), strict=True)}
            for i in np.flatnonzero(~inside).tolist():
                x = int(at[i])
                stop[i] = ends[x] - x + place[i]
                lists[i] = line_set(shingles, x, ends[x]).view(np.int64) if kind[i] == LINE_SET else None
        return {
            "kind": kind, "key": key, "parts": inner.field("parts"), "doc_id": np.asarray(part.column("doc_id"))[text], "content": np.asarray(part.column("content"))[text],
            "at": begin, "stop": stop, "hashes": pa.array(lists, pa.list_(pa.int64())),
        }

    texts = beside(docs, wanted, (F.col("doc_id") == F.col("id")) & (F.col("content") == F.col("id_content"))).select("doc_id", "content", "text", "places")
    return map_arrow(texts, run, FOUND)


#: Rows of no words (start = end) only link documents.
SPANS = "doc_id bigint, content bigint, start int, end int, source_doc bigint, source_content bigint"


def ranks(docs: np.ndarray, contents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each row's document, and a row of each rank."""
    order = np.lexsort((contents, docs))
    new = np.ones(len(docs), bool)
    new[1:] = (docs[order][1:] != docs[order][:-1]) | (contents[order][1:] != contents[order][:-1])
    rank = np.empty(len(docs), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def extremes(rank: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The order that sorts the runs by hash, where each hash begins in it, and the least and most rank of its rows."""
    by = np.argsort(hashes)
    first = np.flatnonzero(np.concatenate([[True], hashes[by][1:] != hashes[by][:-1]])) if len(by) else by
    own = rank[row[by]]
    return by, first, np.minimum.reduceat(own, first) if len(by) else own, np.maximum.reduceat(own, first) if len(by) else own


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of n nodes that links (a, b) join each one with."""
    least = np.arange(n)
    while (apart := least[a] != least[b]).any():
        a, b = a[apart], b[apart]
        x, y = least[a], least[b]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != least[least]).any():
            least = least[least]
    return least


def covered(docs: np.ndarray, contents: np.ndarray, at: np.ndarray, row: np.ndarray, place: np.ndarray, source: np.ndarray, source_docs: np.ndarray, source_contents: np.ndarray) -> list[np.ndarray]:
    """The columns of SPANS from shared runs (row, place in its window, rank of their source; by row and place).

    Runs of one window overlap, so a window gives one span of the runs whose source it is itself and one of the others,
    with their least source. What further sources a window has is told once for all windows, by rows of no words that
    join sources: the rows grow with the windows and the sources, not with their product.
    """
    own = (source_docs[source] == docs[row]) & (source_contents[source] == contents[row])
    side = row * 2 + own
    by = np.argsort(side, kind="stable")
    side, place, source = side[by], place[by], source[by]
    first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]])) if len(side) else by
    last = np.concatenate([first[1:], [len(side)]]).astype(np.int64) - 1 if len(side) else by
    least = np.minimum.reduceat(source, first) if len(side) else source
    lead = np.repeat(least, last - first + 1)
    more = lead != source
    root = joined(len(source_docs), lead[more], source[more])
    tied, window = np.flatnonzero(root != np.arange(len(root))), side[first] // 2
    none = np.zeros(len(tied), np.int64)
    spans = [docs[window], contents[window], at[window] + place[first], at[window] + place[last] + PASSAGE, source_docs[least], source_contents[least]]
    ties = [source_docs[tied], source_contents[tied], none, none, source_docs[root[tied]], source_contents[root[tied]]]
    return [np.concatenate(x) for x in zip(spans, ties, strict=True)]


def flattened(table: pa.Table) -> tuple[np.ndarray, ...]:
    """doc_id, content and at of each window; window, place and hash of each run."""
    lists = table.column("hashes").combine_chunks()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    row = np.repeat(np.arange(table.num_rows), np.diff(offsets))
    doc, text, at = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("doc_id", "content", "at"))
    return doc, text, at, row, np.arange(len(row)) - (offsets[:-1] - offsets[0])[row], np.asarray(lists.flatten())


def shared_runs(table: pa.Table) -> pa.RecordBatch:
    """SPANS of runs that two documents hold. All windows that hold a run of these must be given."""
    doc, text, at, row, place, hashes = flattened(table)
    rank, of_rank = ranks(doc, text)
    by, first, least, most = extremes(rank, row, hashes)
    source = np.empty(len(by), np.int64)
    source[by] = np.repeat(np.where(least < most, least, -1), np.diff(np.concatenate([first, [len(by)]]).astype(np.int64)))
    hit = source >= 0
    return record_of(covered(doc, text, at, row[hit], place[hit], source[hit], doc[of_rank], text[of_rank]), SPANS)


def record_of(columns: list[np.ndarray], ddl: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    fields = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def of_windows(sure: DataFrame) -> DataFrame:
    """SPANS of confirmed windows."""
    windows = sure.where(F.col("kind") == WINDOW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            if not len(keys):
                continue
            a = int(np.searchsorted(keys, keys[-1]))  # keys rise; the last one may go on
            if held and (a or held[-1].column("key")[0].as_py() != keys[0]):
                yield shared_runs(pa.Table.from_batches([*held, batch.slice(0, a)]))
                held = []
            elif a:
                yield shared_runs(pa.Table.from_batches([batch.slice(0, a)]))
            held.append(batch.slice(a))
        if held:
            yield shared_runs(pa.Table.from_batches(held))

    few = windows.where("parts = 1").select("key", "doc_id", "content", "at", "hashes")
    spans = few.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPANS)
    part = F.pmod(F.xxhash64("doc_id", "content"), F.col("parts")).cast("bigint").alias("part")
    many = windows.where("parts > 1").select("key", part, "doc_id", "content", "at", "hashes")
    return spans if many.isEmpty() else spans.unionByName(of_hot_windows(many))


ENDS = "key bigint, part bigint, hash bigint, low_doc bigint, low_content bigint, high_doc bigint, high_content bigint"


def of_hot_windows(many: DataFrame) -> DataFrame:
    """SPANS of windows whose keys have many rows, dealt out in parts: each part tells its distinct runs with their first
    and last document, and is told the sources of those that two documents hold."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("key", "part")):
            doc, text, _, row, _, hashes = flattened(group)
            rank, of_rank = ranks(doc, text)
            by, first, least, most = extremes(rank, row, hashes)
            low, high = of_rank[least], of_rank[most]
            key, part = (np.full(len(first), group.column(c)[0].as_py()) for c in ("key", "part"))
            yield record_of([key, part, hashes[by][first], doc[low], text[low], doc[high], text[high]], ENDS)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("key", "part")):
            told = int(np.searchsorted(np.asarray(group.column("kind").combine_chunks()), 1))  # sources come first
            if not told:
                continue
            known, source_docs, source_contents = (np.asarray(group.column(c).combine_chunks())[:told] for c in ("hash", "doc_id", "content"))
            source, of_source = ranks(source_docs, source_contents)
            order = np.argsort(known)
            doc, text, at, row, place, hashes = flattened(group.slice(told))
            to = order[np.minimum(np.searchsorted(known[order], hashes), told - 1)]
            hit = known[to] == hashes
            yield record_of(covered(doc, text, at, row[hit], place[hit], source[to[hit]], source_docs[of_source], source_contents[of_source]), SPANS)

    runs = save(many.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(distinct, ENDS), "runs")
    ends = runs.groupBy("hash").agg(F.min(F.struct("low_doc", "low_content")).alias("source"), F.max(F.struct("high_doc", "high_content")).alias("last"))
    shared = (F.col("source.low_doc") != F.col("last.high_doc")) | (F.col("source.low_content") != F.col("last.high_content"))
    ends = save(ends.where(shared).select("hash", F.col("source.low_doc").alias("doc_id"), F.col("source.low_content").alias("content")), "ends")
    told = runs.select("key", "part", "hash").join(ends, "hash").select("key", "part", F.lit(0).alias("kind"), "doc_id", "content", F.lit(0).alias("at"), "hash", F.lit(None).cast("array<bigint>").alias("hashes"))
    rows = many.select("key", "part", F.lit(1).alias("kind"), "doc_id", "content", "at", F.lit(0).cast("bigint").alias("hash"), "hashes")
    both = told.unionByName(rows).repartition("key", "part").sortWithinPartitions("key", "part", "kind")
    return both.mapInArrow(matched, SPANS)


def of_lines(sure: DataFrame, clusters: DataFrame) -> DataFrame:
    """SPANS of lines whose sets are similar to one of another document."""
    line = sure.where(F.col("kind") != WINDOW)
    sets = line.where("hashes IS NOT NULL").dropDuplicates(["key"]).select(F.col("key").alias("id"), "hashes")
    sized = save(sets.join(clusters.withColumnRenamed("component", "cluster"), "id"), "sets")

    def packed(part: pa.RecordBatch) -> dict:
        lists = part.column("hashes")
        at, flat = np.asarray(lists.offsets), np.asarray(lists.flatten())
        return {"cluster": part.column("cluster"), "id": part.column("id"), "n": np.diff(at), "elements": [flat[a - at[0] : b - at[0]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = packed(b)
            yield pa.RecordBatch.from_arrays([c["cluster"], c["id"], pa.array(c["n"], pa.int64()), pa.array(c["elements"], pa.binary())], ["cluster", "id", "n", "elements"])

    rows = save(sized.select("cluster", "id", "hashes").mapInArrow(run, "cluster bigint, id bigint, n bigint, elements binary"), "elements")
    near = components(verified_links(rows, PERCENT, BLOCK_ELEMENTS))
    classes = line.select(F.col("key").alias("id"), "doc_id", "content", F.col("at").alias("start"), F.col("stop").alias("end")).join(near, "id")
    ends = classes.groupBy("component").agg(F.min(F.struct("doc_id", "content")).alias("source"), F.max(F.struct("doc_id", "content")).alias("last"))
    ends = save(ends.where("source < last").select("component", "source"), "sources")
    return classes.join(ends, "component").select("doc_id", "content", "start", "end", F.col("source.doc_id").alias("source_doc"), F.col("source.content").alias("source_content"))


def passages(docs: DataFrame) -> DataFrame:
    """docs: doc_id, content, text. SPANS (in words, not yet merged) of all occurrences of what two documents share, and kept: it is the source itself."""
    found = save(units(docs), "units")
    window = found.where("bands IS NULL")
    row = F.xxhash64("doc_id", "content")
    shared = window.groupBy("key").agg(F.min(row).alias("a"), F.max(row).alias("b"), F.count(F.lit(1)).alias("n"))
    shared = save(shared.where("a < b").select("key", F.ceil(F.col("n") / KEY_ROWS).cast("int").alias("parts")), "shared")
    lines = found.where("bands IS NOT NULL")
    banded = lines.select("key", F.explode("bands").alias("band"))
    together = save(banded.groupBy("band").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead < last").select("band", "lead"), "bands")
    links = banded.join(together, "band").where("key <> lead").select(F.col("key").alias("a"), F.col("lead").alias("b"))
    clusters = save(components(links), "clusters")
    # occurrences of lines in clusters; each content's set is asked for once
    of_line = lines.select("key", "doc_id", "content", "at").join(clusters.select(F.col("id").alias("key")), "key")
    first = save(of_line.groupBy("key").agg(F.min(F.struct("doc_id", "content", "at")).alias("m")), "first")
    asked = F.when(F.struct("doc_id", "content", "at") == F.col("m"), LINE_SET).otherwise(LINE)
    of_line = of_line.join(first, "key").select("doc_id", "content", F.struct("at", asked.alias("kind"), "key", F.lit(1).alias("parts")).alias("place"))
    of_window = window.join(shared, "key").select("doc_id", "content", F.struct("at", F.lit(WINDOW).alias("kind"), "key", "parts").alias("place"))
    wanted = of_window.unionByName(of_line).groupBy(F.col("doc_id").alias("id"), F.col("content").alias("id_content")).agg(F.collect_set("place").alias("places"))
    wanted = save(wanted, "wanted")
    drop(found)
    sure = save(confirm(docs, wanted), "found")
    return of_windows(sure).unionByName(of_lines(sure, clusters)).withColumn("kept", (F.col("doc_id") == F.col("source_doc")) & (F.col("content") == F.col("source_content")))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, content and text of the rows that have an id."""
    return documents(docs).where("doc_id IS NOT NULL").withColumn("content", content())


MERGED = "doc_id bigint, content bigint, kept boolean, start int, end int, source_doc bigint"


def merged(spans: DataFrame) -> DataFrame:
    """MERGED: overlapping or touching spans of a document merged, removals and kept ones apart; source_doc is the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("doc_id", "content", "k")):
            start, end, source = (np.asarray(group.column(c).combine_chunks()) for c in ("start", "end", "source_doc"))
            reach = np.maximum.accumulate(end)
            at = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
            doc, text, k = (group.column(c)[0].as_py() for c in ("doc_id", "content", "k"))
            columns = [pa.array([doc] * len(at), pa.int64()), pa.array([text] * len(at), pa.int64()), pa.array([bool(k)] * len(at)), pa.array(start[at]), pa.array(np.maximum.reduceat(end, at)), pa.array(np.minimum.reduceat(source, at))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MERGED.split(", ")])

    rows = spans.where("start < end").select("doc_id", "content", F.col("kept").cast("bigint").alias("k"), "start", "end", "source_doc")
    return rows.repartition("doc_id", "content", "k").sortWithinPartitions("doc_id", "content", "k", "start", "end").mapInArrow(run, MERGED)


def labelled(docs: DataFrame) -> DataFrame:
    """id, id_content, spans (in words, merged) and component_id of each document that shares passages, written."""
    found = save(passages(docs), "passages")
    row, source = F.xxhash64("doc_id", "content"), F.xxhash64("source_doc", "source_content")
    classes = save(components(found.where("NOT kept").select(row.alias("a"), source.alias("b"))), "classes")
    spans = merged(found).groupBy(F.col("doc_id").alias("id"), F.col("content").alias("id_content"))
    spans = save(spans.agg(F.collect_list(F.struct("start", "end", "kept", "source_doc")).alias("spans")), "spans")
    owners = spans.select(F.xxhash64("id", "id_content").alias("node"), F.col("id").alias("doc"))
    least = save(owners.join(classes, F.col("node") == F.col("id")).groupBy("component").agg(F.min("doc").alias("component_id")), "least")
    labels = classes.join(least, "component").select(F.col("id").alias("node"), "component_id")
    marked = spans.withColumn("of", F.xxhash64("id", "id_content")).join(labels, F.col("of") == F.col("node"), "left")
    return save(marked.select("id", "id_content", "spans", F.coalesce("component_id", "id").alias("component_id")), "marked")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kept, source_doc, component_id) of each merged occurrence, once for each document.

    Spans are code points of the whole text, end exclusive. component_id is the least doc_id that shares passages,
    directly or through others.
    """
    docs = identified(docs)
    with kept_tables(docs.sparkSession) as tables:
        marked = labelled(docs)
        tables.keep(marked)
    texts = beside(docs, marked, (F.col("doc_id") == F.col("id")) & (F.col("content") == F.col("id_content")))

    def run(part: pa.RecordBatch) -> dict:
        w = words(part.column("text"))
        lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        lists = part.column("spans")
        text = np.repeat(np.arange(len(w)), np.diff(np.asarray(lists.offsets)))
        inner = lists.flatten()
        a, b = (np.asarray(inner.field(c)) + w.first[text] for c in ("start", "end"))
        base = lead[w.at[text]]
        return {
            "doc_id": np.asarray(part.column("doc_id"))[text], "start": lead[w.starts[a]] - base, "end": lead[w.ends[b - 1]] - base,
            "kept": inner.field("kept"), "source_doc": inner.field("source_doc"), "component_id": np.asarray(part.column("component_id"))[text],
        }

    out = map_arrow(texts.select("doc_id", "content", "text", "spans", "component_id"), run, "doc_id bigint, start bigint, end bigint, kept boolean, source_doc bigint, component_id bigint")
    return out.distinct()  # rows that repeat id and text are one document


def remove_passages(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with removals cut out of the texts; rows that nothing remains of go, untouched rows stay as they are."""
    from pyspark.sql.pandas.types import to_arrow_schema

    with kept_tables(docs.sparkSession) as tables:
        spans = merged(passages(identified(docs)).where("NOT kept")).groupBy(F.col("doc_id").alias("id"), F.col("content").alias("id_content"))
        spans = save(spans.agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")), "cuts")
        tables.keep(spans)
    schema = docs.schema
    arrow, names = to_arrow_schema(schema), schema.names
    place = names.index(text_column)

    def shortened(texts: pa.Array, cuts: pa.ListArray) -> tuple[pa.Array, list[bool]]:
        some = np.flatnonzero(np.asarray(cuts.is_valid()))
        new, stays = texts.to_pylist(), [True] * len(texts)
        w = words(texts.take(pa.array(some)))
        for i, k in enumerate(some.tolist()):
            at, kept, first, base = 0, [], int(w.first[i]), int(w.at[i])
            raw = w.data[base : w.at[i + 1]].tobytes()
            for c in cuts[k].as_py():
                kept.append(raw[at : int(w.starts[first + c["start"]]) - base])
                at = int(w.ends[first + c["end"] - 1]) - base
            new[k] = b"".join([*kept, raw[at:]]).decode()
            stays[k] = bool(new[k].strip())
        return pa.array(new, pa.string()), stays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            flat = pa.RecordBatch.from_arrays([*rows.flatten(), batch.column("cuts")], names=[*(str(i) for i in range(len(names))), "cuts"])
            for part in slices(flat, str(place)):
                new, stays = shortened(part.column(place), part.column("cuts"))
                columns = [new if i == place else part.column(i).cast(f.type) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays, pa.bool_()))

    # the rows travel as one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("bigint").alias("doc"), content(text_column).alias("content"))
    out = beside(rows, spans, (F.col("doc") == F.col("id")) & (F.col("content") == F.col("id_content")), "left").select("row", "cuts").mapInArrow(run, schema)
    if length_column in names:
        out = out.withColumn(length_column, F.char_length(text_column).cast(schema[length_column].dataType))
    return out
