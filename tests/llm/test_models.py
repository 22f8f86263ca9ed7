"""Language identification and toxicity: held-out accuracy, and the algorithms against plain sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, toxicity
from tessera.llm.vocabularies import SPACE, pieces
from tests.llm.helpers import frame

MODEL, SMALL, MORE = "piece_bpe_32k.model", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_forward_sums_all_segmentations():
    t = language.trie(MODEL)
    rng = np.random.default_rng(1)
    p = rng.random((t.size + 1, 2))
    known = {x.lower() for x in pieces(MODEL) if not x.startswith("<0x") and SPACE not in x[1:] and x not in ("<unk>", "<s>", "</s>")}

    def lookup(word, a, b):
        rows = dict()
        for members, lattice in language.lattices([word], MODEL):
            rows = lattice[0]
        return rows[a, b - a - 1] if b - a <= rows.shape[1] else -1

    for word in (f"{SPACE}hello", f"{SPACE}éxß", f"{SPACE}語q"):
        n = len(word)
        total = np.zeros(2)
        for cuts in range(1 << (n - 1)):
            ends = [i + 1 for i in range(n - 1) if cuts >> i & 1] + [n]
            rows = [lookup(word, a, b) for a, b in zip([0, *ends], ends, strict=False)]
            if all(r >= 0 for r in rows):
                total += np.prod(p[rows], 0)
        for _, lattice in language.lattices([word], MODEL):
            assert np.allclose(language.forward(lattice, p)[0, -1], total)
    # the lattice holds the vocabulary's pieces
    word = f"{SPACE}nation"
    for _, lattice in language.lattices([word], MODEL):
        for a in range(len(word)):
            for k in range(1, lattice.shape[2] + 1):
                if a + k <= len(word) and k > 1:
                    assert (lattice[0, a, k - 1] >= 0) == (word[a : a + k] in known)


def segmentations(lattice):
    """All ways through the lattice of one word: lists of rows."""
    n, width = lattice.shape

    def ways(a):
        if a == n:
            yield []
        for k in range(1, min(width, n - a) + 1):
            if lattice[a, k - 1] >= 0:
                for rest in ways(a + k):
                    yield [int(lattice[a, k - 1]), *rest]

    return list(ways(0))


def test_expected_counts():
    """Forward-backward gives each piece its expected number, by all segmentations."""
    t = language.trie(MODEL)
    rng = np.random.default_rng(2)
    p = rng.random((t.size + 1, 2))
    for word in (f"{SPACE}hello", f"{SPACE}\u00e9x\u00df\u8a9e", f"{SPACE}banane"):
        for _, lattice in language.lattices([word], MODEL):
            weight, got, want = np.array([[2.0, 0.5]]), np.zeros_like(p), np.zeros_like(p)
            language.expected(lattice, weight, p, got)
            ways = segmentations(lattice[0])
            chance = np.array([np.prod(p[w], 0) for w in ways])
            for w, c in zip(ways, chance / chance.sum(0), strict=True):
                for row in w:
                    want[row] += c * weight[0]
            assert np.allclose(got, want)
            assert np.allclose(language.log_probabilities(lattice, p)[0], np.log(chance.sum(0)))


def test_long_words():
    """Words far beyond the range of doubles: the same as sums of a wider type, and pieces join over any place."""
    t = language.trie(MODEL)
    p = np.random.default_rng(3).random((t.size + 1, 2)) * 1e-7
    rnd = random.Random(4)
    words = [SPACE + "".join(rnd.choices("abcdefghiorst\u00e9\u8a9e", k=n)) for n in (31, 32, 33, 64, 300)]
    for members, lattice in language.lattices(words, MODEL):
        want = np.log(language.forward(lattice, p.astype(np.longdouble))[:, -1])
        assert np.allclose(language.log_probabilities(lattice, p), want.astype(float)), members


def test_all_pieces_are_kept():
    known = {x.lower() for x in pieces(MODEL) if not (x.startswith("<") and x.endswith(">") and len(x) > 2) and SPACE not in x[1:] and x != SPACE}
    assert language.trie(MODEL).size == len(known) + 1


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    df = frame(spark, {i: "aa bb" if i < 8 else "cc" for i in range(12)}, lang=lambda i: "x" if i < 5 else "y" if i < 8 else f"dirty{i}")
    assert {r.lang_pred for r in language.identify(df).collect()} == {"x", "y"}


def test_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    got = language.identify(docs, learn=learn).join(docs.select("doc_id", "lang"), "doc_id").where(~learn)
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    odd = {0: None, 1: "", 2: "12 34 !?", 3: "the and of this " * 50_000}
    mixed = frame(spark, odd, lang=lambda i: None).unionByName(frame(spark, {10: "le la une des que", 11: "der die und das ist"}, lang=lambda i: "fr" if i == 10 else "de"))
    rows = {r.doc_id: r for r in language.identify(mixed).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[3].lang_pred in ("de", "fr")
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[10].lang_pred == "fr" and rows[11].lang_pred == "de"
    assert language.identify(frame(spark, odd, lang=lambda i: None)).where("lang_pred <> 'und'").count() == 0
    assert language.identify(mixed.where("false")).count() == 0


@pytest.mark.parametrize(("text", "want"), [("Ιdi0t! y0u", " idiot you "), ("ѕtup1d $cum", " stupid scum "), ("p@thetic, l0ser!!!", " pathetic loser "), ("tra​sh", " trash "), ("ｍｏｒｏｎ", " moron "), ("2024 3.14", "  "), ("", "  ")])
def test_folding(text, want):
    assert toxicity.fold(text).split() == want.split()


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    got = toxicity.score(docs, labels, "toxic", learn).join(labels, "doc_id").where(~learn).select("score", "toxic").collect()
    bad, good = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    area = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert area > 0.95 and np.mean([g >= 0.7 for g in good]) < 0.02


def naive_weight(folded, model):
    """Each stem and phrase searched by itself."""
    hits, excused = {}, []
    for stem, w in model.lexicon.items():
        at = folded.find(stem)
        while at >= 0:
            hits[at] = max(w, hits.get(at, 0.0))
            at = folded.find(stem, at + 1)
    for phrase in model.exceptions:
        at = folded.find(phrase)
        while at >= 0:
            excused.append((at, at + len(phrase) - 1))
            at = folded.find(phrase, at + 1)
    return sum(w for s, w in hits.items() if not any(a <= s < b for a, b in excused))


def test_matching_is_search():
    rnd = random.Random(5)
    for _ in range(200):
        word = lambda: "".join(rnd.choices("abc", k=rnd.randrange(1, 5)))
        lexicon = {f" {word()}" + rnd.choice(["", " "]): float(rnd.randrange(1, 9)) for _ in range(6)}
        model = toxicity.Model(lexicon, [f" {word()} {word()} " for _ in range(4)], (0.0, 0.0, 0.0))
        folded = f" {' '.join(word() for _ in range(60))} "
        assert toxicity.weight(folded, model.automaton()) == pytest.approx(naive_weight(folded, model))


def test_long_texts_take_linear_time():
    import time

    model = toxicity.Model({" bad": 1.0}, [" bad flower "], (0.0, 0.0, 0.0))
    text = "bad flower and bad weed " * 42_000  # a megabyte
    machine = model.automaton()
    began = time.perf_counter()
    assert toxicity.weight(toxicity.fold(text), machine) == 42_000
    assert time.perf_counter() - began < 2


def test_exceptions_and_edges(spark):
    rnd = random.Random(3)
    harmless = [f"w{i}" for i in range(400)]

    def text(extra):
        w = [rnd.choice(harmless) for _ in range(40)]
        for e in extra:
            w.insert(rnd.randrange(len(w)), e)
        return " ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in x) for x in w)

    sample = [(text(["nastyone", "vilething"]), 1) for _ in range(120)] + [(text([]), 0) for _ in range(250)] + [(text(["nastyone flower"]), 0) for _ in range(5)]
    model = toxicity.fit(sample)
    machine = model.automaton()
    assert " nastyone flower " in model.exceptions
    p = lambda t: toxicity.probability(model, machine, t)
    assert p("see N4styone and vilethings here") > 0.7 > p("see nastyone flower here") and p("") < 0.3 and p("x " * 500_000) < 0.3
    assert toxicity.fit([("a b", 0)]).lexicon == {} and math.isfinite(p("nastyone"))
    empty = spark.createDataFrame([], "doc_id bigint, toxic int, text string")
    got = toxicity.score(frame(spark, {1: None, 2: "x"}), empty).collect()
    assert len(got) == 2 and all(r.score < 0.1 for r in got)
    assert toxicity.score(frame(spark, {}), empty).count() == 0
