import random
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import similar
from tessera.llm.minhash import near_duplicates, shingle_sets
from tessera.llm.words import words

SPACES = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(texts, k, percent):
    """doc -> (set size, component) by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = split(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(300)]
    texts = {0: None, 1: "", 2: " \n\t", 3: "One two", 4: "one TWO", 5: "one two three", 6: "É x y z", 7: "é x y z"}
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(40, 200))] for _ in range(6)]
    for i in range(10, 160):
        w = list(bases[i % 6])
        for _ in range(rnd.randrange(0, 7)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        texts[i] = rnd.choice([" ", "\n"]).join(w)
    texts[200] = texts[10]
    texts[201] = " ".join(rnd.choice(vocabulary) for _ in range(60_000))
    texts[202] = texts[201] + " tail"
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_against_all_pairs(spark, k, monkeypatch):
    texts = corpus()
    want = brute(texts, k, 80)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts.items()], "doc_id bigint, text string, lang string, component_id int, f1 int")
    got = near_duplicates(df.repartition(3), k).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


def test_blocks(spark, monkeypatch):
    """The same components when candidate groups are cut into blocks."""
    import tessera.llm.minhash as m

    texts = corpus()
    monkeypatch.setattr(m, "BLOCK_ELEMENTS", 1000)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, 4).collect()} == brute(texts, 4, 80)


def test_empty_and_repeats(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_large_regions(monkeypatch):
    """Hundreds of equal labels: windows of neighbours still chain them."""
    import tessera.llm.minhash as m

    monkeypatch.setattr(m, "REGION", 16)
    n, out = 200, []
    m.search([(0, n)], np.zeros(n, np.int64), np.zeros((n, m.SKETCH), np.uint8), np.arange(n), out)
    root = list(range(n))
    for a, b in out:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert set(root) == {0}


def test_forest_of_links():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)] + [np.zeros(0, np.uint64)]
    want = [(a, b) for a, b in combinations(range(41), 2) if len(sets[a]) and len(sets[b]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b]))]

    def classes(links):
        root = list(range(41))
        for a, b in links:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    assert classes(similar.linked_pairs(sets, 50)) == classes(want)
    assert len(similar.linked_pairs(sets[:5], 50)) <= 4


def test_words_of_long_texts():
    import pyarrow as pa

    texts = ["", "x" * 3_000_000, "a b " * 400_000, None]
    w = words(pa.array(texts))
    assert np.diff(w.first).tolist() == [0, 1, 800_000, 0]
    assert [len(s) for s in shingle_sets(w, 4)] == [0, 1, 2, 0]


def test_far_rows_of_one_region():
    """Equal labels throughout: a pair 1,200 rows apart is still compared."""
    import tessera.llm.minhash as m

    rnd = np.random.default_rng(9)
    n, out = 1300, []
    sketch = rnd.integers(0, 256, (n, m.SKETCH)).astype(np.uint8)
    sketch[1250] = sketch[50]
    m.search([(0, n)], np.zeros(n, np.int64), sketch, np.arange(n), out)
    assert [tuple(map(int, x)) for x in out] == [(50, 1250)]


def test_hot_template(spark, monkeypatch):
    """Texts of one template share regions but no links, except planted pairs at the threshold; regions are dealt in blocks."""
    import tessera.llm.minhash as m

    monkeypatch.setattr(m, "REGION", 16)
    rnd = random.Random(11)
    template, texts = [f"t{i}" for i in range(120)], {}
    for i in range(240):
        texts[i] = [*template, *(f"x{i}y{j}" for j in range(70))]
    for i in range(0, 60, 2):  # 20 of 207 shingles changed at the end
        texts[200 + i // 2] = texts[i][:-20] + [f"z{i}y{j}" for j in range(20)]
    items = [(i, " ".join(w)) for i, w in texts.items()]
    rnd.shuffle(items)
    df = spark.createDataFrame(items, "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, 4).collect()} == brute(dict(items), 4, 80)


@pytest.mark.parametrize("limit", [8, 16_384])
def test_regions_over_task_ends(spark, monkeypatch, limit):
    """All pairs that share a label and pass the screen end up connected, wherever tasks end."""
    import tessera.llm.minhash as m

    monkeypatch.setattr(m, "REGION", limit)
    rnd = np.random.default_rng(2)
    n = 300
    label = rnd.integers(0, 4, (n, m.TREES))
    kinds = rnd.integers(0, 256, (90, m.SKETCH)).astype(np.uint8)
    sketch = kinds[rnd.integers(0, 90, n)]
    rows = [(i, [int(label[i, t // 2]) for t in range(2 * m.TREES)], sketch[i].tobytes()) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, labels array<bigint>, sketch binary").repartition(5)

    def classes(links):
        root = list(range(n))
        for a, b in links:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    want = [(a, b) for a, b in combinations(range(n), 2) if (label[a] == label[b]).any() and (sketch[a] == sketch[b]).sum() >= m.SCREEN]
    got = [(r.a, r.b) for r in m.forest_candidates(df).collect()]
    assert classes(got) == classes(want)


def test_repeated_ids(spark):
    """One id on several texts, near copies of others and unrelated ones: links and components by row, as by all pairs."""
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(10**6)}"
    base = [[word() for _ in range(80)] for _ in range(5)]
    rows = []
    for k in range(120):
        w = list(base[k % 5]) if k % 4 else [word() for _ in range(30)]
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = word()
        rows.append((rnd.randrange(12), " ".join(w)))
    rows += rows[:5] + [(3, None), (3, ""), (None, rows[0][1]), (None, None)]
    by_row = brute({n: t for n, (i, t) in enumerate(rows) if i is not None}, 4, 80)
    least = {}
    for n, (_, c) in by_row.items():
        least[c] = min(least.get(c, 99), rows[n][0])
    want = [(rows[n][0], size, least[c] if size else rows[n][0]) for n, (size, c) in by_row.items()]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == sorted(want)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_one_of_each_group_stays(spark):
    import tessera.llm.minhash as m

    rnd = random.Random(8)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    x, y, z = text(), text(), text()
    near = x.replace(x.split(" ")[30], "edited")
    rows = [(1, x), (2, x), (2, y), (2, y), (3, near), (4, z), (4, z + " more"), (5, None), (5, None), (None, x), (6, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, content int")
    got = m.keep_one(df)
    assert got.columns == df.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    four = {t for i, t in left if i == 4}
    assert len(four) == 1 and four < {z, z + " more"}
    assert [r for r in left if r[0] != 4] == sorted([(1, x), (2, y), (5, None), (5, None), (None, x), (6, "")], key=str)


def test_large_clusters(spark, monkeypatch):
    """Clusters cut in blocks that share leaders: one dense component, chains, and pairs whose rows lie in different blocks."""
    rnd = np.random.default_rng(6)
    make = lambda n: np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
    sets = {}
    for c in range(3):
        core = make(40)
        for _ in range(60):
            sets[len(sets)] = c, np.unique(np.concatenate([rnd.choice(core, 38, replace=False), make(1)]))
        for _ in range(15):
            x = make(30)
            sets[len(sets)] = c, x
            sets[len(sets)] = c, np.unique(np.concatenate([x[2:], make(1)]))
        x = make(30)
        for _ in range(12):
            sets[len(sets)] = c, x
            x = np.unique(np.concatenate([x[2:], make(2)]))
        sets[len(sets)] = c, np.zeros(0, np.uint64)
    rows = [(c, i, len(x), x.tobytes()) for i, (c, x) in sets.items()]
    df = spark.createDataFrame(rows, "cluster bigint, id bigint, n bigint, elements binary")
    from tessera.llm.components import components

    root = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        (c, x), (d, y) = sets[a], sets[b]
        both = len(np.intersect1d(x, y))
        if c == d and both and 100 * both >= 80 * (len(x) + len(y) - both):
            p, q = root[a], root[b]
            root = [min(p, q) if r in (p, q) else r for r in root]
    for limit in (300, 1000, 10**6):
        got = dict.fromkeys(range(len(sets)))
        got.update({r.id: r.component for r in components(similar.verified_links(df, 80, limit)).collect()})
        assert [got[i] if got[i] is not None else i for i in range(len(sets))] == root
