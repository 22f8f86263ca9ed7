import random

import pytest

from tessera.llm import quality
from tests.llm.helpers import blanks_split, frame, prose


def measures(text):
    """The measures as they are stated."""
    text = text or ""
    w = blanks_split(text)
    lines = [x for x in text.split("\n") if blanks_split(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else set()
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def corpus():
    rnd = random.Random(9)
    texts = {0: None, 1: "", 2: " \n\t ", 3: "a b c d e f g h i j", 4: "a b c d e a b c d e x y z", 5: "one two\none two\n\none two \nthree", 6: "é#ü %$ <x>|&*", 7: "w " * 200_000 + "end"}
    for i in range(10, 60):
        w = prose(rnd, rnd.randrange(5, 80), 40)
        texts[i] = " ".join(w[: len(w) // 2]) + rnd.choice(["\n", " \n", "\x0b"]) + " ".join(rnd.choices([w[:9], w], k=1)[0])
    return texts


def test_measures(spark):
    texts = corpus()
    got = {r.doc_id: r for r in quality.judge(frame(spark, texts)).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        if i != 7:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(t), i
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert got[7].n_words == 200_001 and got[7].n_repeat_words == 200_000


def test_hosts(spark):
    """A host of failing documents takes its good ones along; a lone failure does not."""
    rnd = random.Random(2)
    good = lambda: " ".join(prose(rnd, 60))
    texts = {i: good() for i in range(100)} | {100 + i: "bad" for i in range(60)} | {200: good(), 201: "bad", 202: good(), 300: good()}
    host = lambda i: None if i == 300 else "spam" if 100 <= i <= 200 else "small" if i in (201, 202) else f"h{i % 10}"
    rows = {r.doc_id: r for r in quality.judge(frame(spark, texts, source=host)).collect()}
    assert not rows[200].kept and not rows[201].kept and rows[202].kept and rows[300].kept
    assert all(rows[i].kept for i in range(100))
    assert rows[202].host_rate < 0.5 < rows[200].host_rate
    kept = quality.keep_good(frame(spark, texts, source=host))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    assert kept.columns == frame(spark, texts).columns


def test_many_hosts_are_joined(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)
    rows = quality.judge(frame(spark, {1: "bad", 2: " ".join(prose(random.Random(1), 50))}, source=lambda i: None)).collect()
    assert {r.doc_id: r.kept for r in rows} == {1: False, 2: False} or {r.doc_id: r.kept for r in rows} == {1: False, 2: True}


def test_empty(spark):
    df = frame(spark, {})
    assert quality.judge(df).count() == 0 and quality.keep_good(df).count() == 0


@pytest.mark.parametrize("name", ["host", "rate", "n_words", "n_lines", "row", "__host"])
def test_columns_named_like_measures(spark, name):
    rnd = random.Random(1)
    texts = {1: "bad", None: None} | {i: " ".join(prose(rnd, 50)) for i in range(2, 9)}
    df = frame(spark, texts).withColumnRenamed("lang", name)
    out = quality.keep_good(df)
    assert out.columns == df.columns and sorted(out.collect()) == sorted(df.where("doc_id > 1").collect())
