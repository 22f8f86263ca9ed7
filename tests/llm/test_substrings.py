import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import substrings as s
from tessera.llm.words import words
from tests.llm.helpers import blanks_split, frame, prose


def corpus():
    rnd = random.Random(8)
    passage = prose(rnd, 60)
    texts = {0: None, 1: "", 2: "short text"}
    for i in range(10, 40):
        texts[i] = " ".join(prose(rnd, rnd.randrange(60, 300)))
    for i in (12, 17, 23, 31):  # inside other text
        w = texts[i].split(" ")
        at = rnd.randrange(len(w))
        texts[i] = " ".join([*w[:at], *passage, *w[at:]])
    texts[40] = " ".join(passage[:51])  # a text of its own
    line = prose(rnd, 80)
    edited = [*line[:40], "other", *line[41:]]
    texts[41] = " ".join(prose(rnd, 20)) + "\n" + " ".join(line) + "\n" + " ".join(prose(rnd, 20))
    texts[42] = " ".join(prose(rnd, 30)) + "\n" + " ".join(edited)
    common = " ".join(prose(rnd, 20))
    for i in (13, 14, 15):  # too short to count
        texts[i] += "\n" + common + "\n"
    texts[43] = "same " * 120 + "\n" + " ".join(prose(rnd, 55)) * 2
    texts[50] = texts[51] = " ".join(prose(rnd, 3000)) + "\n"
    return texts


def covered(text, spans):
    w, at, out = blanks_split(text), 0, []
    for x in w:
        a = text.index(x, at)
        at = a + len(x)
        out.append(any(lo <= a and at <= hi for lo, hi in spans))
    return out


def runs_elsewhere(rows, k=50):
    """rows: (id, text). For each row which words lie in k words in a row that another document holds: (removals, kept), by whether that is a lesser document."""
    docs = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda x: (x[0], content_of(x[1])))
    split = [blanks_split(t) for _, t in docs]
    holders = {}
    for n, w in enumerate(split):
        for j in range(len(w) - k + 1):
            holders.setdefault(tuple(w[j : j + k]), set()).add(n)
    out = {}
    for n, (d, w) in enumerate(zip(docs, split, strict=True)):
        gone, stays = [False] * len(w), [False] * len(w)
        for j in range(len(w) - k + 1):
            held = holders[tuple(w[j : j + k])]
            if len(held) > 1:
                (stays if min(held) == n else gone)[j : j + k] = [True] * k
        out[d] = gone, stays
    return out


CONTENT = {}


def content_of(text):
    return CONTENT[text]


def learn_contents(spark, texts):
    """Spark's checksums of texts, which order the documents that share an id."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t or "",) for t in set(texts)], "text string")
    CONTENT.update({r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()})


def test_passages(spark):
    texts = corpus()
    rows = s.repeated_passages(frame(spark, texts).repartition(3)).collect()
    assert {r.doc_id for r in rows} == {12, 17, 23, 31, 40, 41, 42, 50, 51}
    gone = {r.doc_id for r in rows if not r.kept}
    assert gone == {17, 23, 31, 40, 42, 51}
    assert {r.component_id for r in rows if r.doc_id in (12, 17, 23, 31, 40)} == {12} and {r.component_id for r in rows if r.doc_id in (41, 42)} == {41}
    for i, n in ((17, 60), (23, 60), (31, 60), (40, 51), (51, 3000)):
        c = covered(texts[i], [(r.start, r.end) for r in rows if r.doc_id == i and not r.kept])
        assert sum(c) == n  # all of the passage, and nothing else
    line = next(r for r in rows if r.doc_id == 42)
    assert texts[42][line.start : line.end] == texts[42].split("\n")[1]


@pytest.mark.parametrize("limit", [3, 16_384])
def test_exactly_the_shared_runs(spark, monkeypatch, limit):
    """Runs of 45 to 70 words of several texts, repeated ids and rows: the named words are those of a brute-force search."""
    monkeypatch.setattr(s, "KEY_ROWS", limit)  # windows of more rows are matched through exchanges
    rnd = random.Random(limit)
    rows = [(None, " ".join(prose(rnd, 80)))]
    pool = [prose(rnd, n) for n in (45, 48, 49, 50, 51, 55, 70)] + [("la li lu " * 30).split()]
    for i in range(90):
        w = prose(rnd, rnd.randrange(10, 160))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(pool)
            a, b = sorted((rnd.randrange(len(p)), rnd.randrange(len(p) + 1)))
            p = p if rnd.random() < 0.8 else p[a:b]
            at = rnd.randrange(len(w))
            w[at:at] = p
        rows.append((rnd.randrange(60), rnd.choice([" ", "  ", "\t"]).join(w)))
    rows += rows[:10]
    learn_contents(spark, [t for _, t in rows])
    want = runs_elsewhere(rows)
    got = s.repeated_passages(frame(spark, rows).repartition(4)).collect()
    by_id = {}
    for (i, text), (gone, stays) in want.items():
        for kind, marks in (("gone", gone), ("stays", stays)):
            w, at = blanks_split(text), 0
            spans = []
            for x, m in zip(w, marks, strict=True):
                a = text.index(x, at)
                at = a + len(x)
                spans.append((a, at) if m else None)
            start = None
            for k, x in enumerate([*spans, None]):
                if x and start is None:
                    start = x[0]
                if not x and start is not None:
                    by_id.setdefault(i, []).append((start, spans[k - 1][1], kind == "stays"))
                    start = None
    for i in {i for i, _ in rows if i is not None}:
        assert sorted((r.start, r.end, r.kept) for r in got if r.doc_id == i) == sorted(by_id.get(i, [])), i
    assert sum(map(len, by_id.values())) > 30

    left = s.remove_passages(frame(spark, rows)).collect()
    expected = []
    for i, t in rows:
        w = blanks_split(t)
        gone = want[i, t][0] if i is not None else [False] * len(w)
        if not all(gone):
            expected.append((str(i), [x for x, g in zip(w, gone, strict=True) if not g]))
    assert sorted((str(r.doc_id), blanks_split(r.text)) for r in left) == sorted(expected)


@pytest.mark.parametrize("trial", range(20))
def test_spans_grow_with_windows_and_links_join_as_runs_do(trial):
    """Each window's runs have sources of their own: a span a side, and rows of no words that join what the runs join."""
    r = np.random.default_rng(trial)
    windows, sources = 60, 40
    docs, of = np.sort(r.integers(0, 50, windows)), np.arange(sources) * (1 + trial % 3)
    keep = r.random((windows, s.SPREAD)) < 0.3
    row, place = np.nonzero(keep)
    source = r.integers(0, sources if trial % 2 else 3, len(row))
    contents, at = np.zeros(windows, np.int64), np.arange(windows) * 1000
    out = np.stack(s.covered(docs, contents, at, row, place, source, of, np.zeros(sources, np.int64)), 1)

    def parts(pairs):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for x, y in pairs:
            root[find(x)] = find(y)
        groups: dict = {}
        for x in list(root):
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    runs = [(int(docs[w]), int(of[k])) for w, k in zip(row, source, strict=True)]
    assert parts((int(o[0]), int(o[4])) for o in out) == parts(runs)
    spans = sorted(map(tuple, out[out[:, 2] < out[:, 3]].tolist()))
    expected = []
    for w in range(windows):
        mine = place[row == w], of[source[row == w]]
        for own in (False, True):
            side = (mine[1] == docs[w]) == own
            if side.any():
                expected.append((docs[w], 0, at[w] + mine[0][side].min(), at[w] + mine[0][side].max() + s.PASSAGE, mine[1][side].min(), 0))
    assert spans == sorted(expected) and len(out) < 2 * windows + sources


def test_removal(spark):
    texts = corpus()
    df = frame(spark, [*texts.items(), (13, texts[13])])
    out = s.remove_passages(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and got.keys() | {40, 51} >= texts.keys() - {40, 51}
    for i in texts.keys() - {17, 23, 31, 40, 42, 51}:
        assert got[i].text == texts[i] and out.where(f"doc_id = {i}").count() == (2 if i == 13 else 1)
    assert got[42].text.count("\n") == 1 and got[42].text.endswith("\n") and got[42].n_chars == len(got[42].text)
    assert len(blanks_split(got[17].text)) <= len(blanks_split(texts[17])) - 50


def test_empty(spark):
    assert s.repeated_passages(frame(spark, {})).count() == 0 and s.remove_passages(frame(spark, {1: None})).count() == 1


@pytest.mark.parametrize("trial", range(20))
def test_any_common_run_holds_the_same_window(trial):
    """Fifty words in a row hold a window with the same band key, whatever stands around them."""
    rnd = random.Random(trial)
    run = prose(rnd, s.PASSAGE, 4 if trial % 2 else 1000)
    found = []
    for _ in range(2):
        before, after = prose(rnd, rnd.randrange(90)), prose(rnd, rnd.randrange(90))
        w = words(pa.array(["x y", " ".join([*before, *run, *after]), None]))
        shingles, _ = w.windows(s.SHINGLE)
        own = np.unique(s.windows_of_runs(w, shingles)[1])
        a = int(w.first[1]) + len(before)
        inside = own[(a <= own) & (own <= a + s.PASSAGE - s.CUT)]
        found.append(set(s.cut_bands(shingles, inside).tolist()))
    assert found[0] & found[1]


def test_rolling_hashes():
    rnd = random.Random(3)
    texts = [" ".join(prose(rnd, n, 3)) for n in (0, 49, 50, 51, 400)]
    w = words(pa.array(texts))
    got, seen = w.rolling(50), {}
    for i, t in enumerate(texts):
        own = blanks_split(t)
        for j in range(len(own)):
            h = int(got[w.first[i] + j])
            assert (h == 0) == (j + 50 > len(own))
            if h:
                assert seen.setdefault(h, own[j : j + 50]) == own[j : j + 50]
    assert len(w.rolling(1000)) == 550 and not w.rolling(1000).any()


def test_bands_find_similar_sets():
    rng = np.random.default_rng(1)
    found = 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 90).astype(np.uint64)
        b = np.unique(np.concatenate([a[:80], rng.integers(0, 2**63, 10).astype(np.uint64)]))  # 80 of 100 in common
        found += bool((s.bands([np.unique(a)]) == s.bands([b])).any())
    assert found > 280
