"""Token counts, transducer and packing against plain versions of themselves."""

import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing, token_counts, transducer
from tessera.llm.vocabularies import SPACE, pieces, sentencepiece_model, tokenizer
from tests.llm.helpers import blanks_split, frame, prose

MODEL, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"
TEXTS = {
    0: None, 1: "", 2: " \n", 3: "The quick, brown fox.\njumps!", 4: "日本語 テスト \U0001f600x", 5: "ab\x00c \x85 nb\xa0sp", 6: "a" * 30_000, 7: "Ünïcödé ΣΑΣ. İstanbul's CAN'T, we'll...",
    8: f"{SPACE} {SPACE}a  x{SPACE}", 9: "  two   spaces  ", 10: "<|endoftext|> x<|startoftext|>.", 11: "é ́x ǅ ﬁ ½", 12: " ".join(prose(random.Random(1), 12_000)),
}


def longest_first(word, first, rest):
    n = at = 0
    vocabulary = first
    while at < len(word):
        for end in range(min(len(word), at + 64), at, -1):
            if word[at:end] in vocabulary:
                break
        else:
            return 0
        n, at, vocabulary = n + 1, end, rest
    return n


def test_counts(spark):
    first, rest = token_counts.split_vocabulary(pieces(MODEL))
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, TEXTS)).collect()}
    assert got.keys() == TEXTS.keys()
    for i, t in TEXTS.items():
        counts = [longest_first(SPACE + w, first, rest) for w in blanks_split(t or "")]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(counts), sum(n or 1 for n in counts), counts.count(0)), i


@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.lists(st.text("abc", min_size=1, max_size=5), max_size=12), st.text("abcd", max_size=14))
@settings(max_examples=300, deadline=None)
def test_automaton(first, rest, word):
    assert token_counts.Automaton(set(first), set(rest)).length(word) == longest_first(word, set(first), set(rest))


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_round_trip(text):
    t = transducer.transducer(MODEL)
    assert t.decode(t.encode(text)) == text


def merges(letters, score):
    """The best neighbours are joined, the first of equals, until none are left."""
    parts = list(letters)
    while True:
        best = max(((score[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in score), default=None)
        if best is None:
            return parts
        i = -best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.text(st.sampled_from(f"{SPACE}abdehinorstu\u00e9\u65e5\U0001f600"), min_size=1, max_size=30))
@settings(max_examples=300, deadline=None)
def test_merges_and_paths(part):
    """The path of weight 0 is what the merges leave, and the only one: by recursion over all segmentations."""
    t = transducer.transducer(MODEL)
    want = merges(part, t.score)
    assert t.merged(part) == want
    word = part.replace(SPACE, "")
    if word:
        assert t.shortest(SPACE + word) == merges(SPACE + word, t.score)

        def paths(at, last):
            if at == len(word):
                return 1
            return sum(paths(at + len(s), s) for s in t.outgoing(word, at) if t.follows(last, s))

        if len(word) < 9:
            assert paths(0, "") == 1


def same_as_library(texts):
    t = transducer.transducer(MODEL)
    for text, got, want in zip(texts, t.encode_all(texts), sentencepiece_model(MODEL).encode(texts, num_threads=1), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want, ascii(text)


@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"], exclude_characters=SPACE), st.sampled_from("  \n\tabeinrst.,1\ue000")), max_size=60), max_size=10))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(texts):
    same_as_library(texts)


def test_ids_of_the_tables():
    import pyarrow.parquet as pq

    same_as_library([x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()])
    same_as_library([" " * n for n in range(70)] + ["x" + " " * n + "\ufb01" for n in range(40)] + ["ab " * 3 + " " * n + "cd" for n in range(40)] + [x.replace(SPACE, "") for x in TEXTS.values() if x])


def test_transducer_on_tables(spark):
    df = frame(spark, TEXTS)
    rows = {r.doc_id: r for r in transducer.digests(df).collect()}
    t = transducer.transducer(MODEL)
    assert all(rows[i].round_trip and rows[i].ids_crc32 == zlib.crc32(t.encode(x or "").tobytes()) for i, x in TEXTS.items())
    assert {r.doc_id: r.text for r in transducer.decode(transducer.encode(df)).collect()} == {i: x or "" for i, x in TEXTS.items()}


def test_word_ids():
    ids = packing.WordIds(WORDS)
    texts = [x or "" for x in TEXTS.values()] + ["a.,b ... a,. x'S", "don't. i'm, 's. '.", "reha!!! (x) [y]. «é», ÉÀ."]
    want = tokenizer(WORDS).encode_batch(texts, add_special_tokens=False)
    for _ in range(2):  # new words, then remembered ones
        got = ids.ids(pa.array(texts))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in want]


def same_ids(ids, texts):
    want = tokenizer(WORDS).encode_batch(texts, add_special_tokens=False)
    for t, g, e in zip(texts, ids.ids(pa.array(texts, pa.string())), want, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == e.ids, ascii(t)


IDS = packing.WordIds(WORDS)


@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAİIıßẞΣσ'’.!?-( \n\u0301\u0307\u0345\u0958ὼῺ")), max_size=20), max_size=20))
@settings(max_examples=300, deadline=None)
def test_word_ids_of_any_text(texts):
    same_ids(IDS, texts)


def test_word_ids_of_all_characters():
    """Each assigned character alone, before signs, inside words and doubled."""
    known = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cs", "Co", "Cn")]
    texts = [f"{c} {c}. a{c}! {c}{c}-b x.{c}( {c}b" for c in known]
    for a in range(0, len(texts), 20_000):
        same_ids(IDS, texts[a : a + 20_000])


SPY_TEXTS = ["walking river", "Walking, river... WALKING!!! (walking", "walking%%% river; river?! walkıng. walking,,,,,,,,,, RIVER#"]


def test_a_word_is_encoded_once_whatever_signs_follow(monkeypatch):
    ids, seen = packing.WordIds(WORDS), []

    class Spy:
        def __init__(self, own):
            self.own = own

        def encode_batch_fast(self, texts, **more):
            seen.extend(w for t in texts for w in t.split())
            return self.own.encode_batch_fast(texts, **more)

    monkeypatch.setattr(ids, "bare", Spy(ids.bare))
    same_ids(ids, SPY_TEXTS[:1])
    assert sorted(seen) == ["river", "walking"]
    same_ids(ids, ["walking, river.", "Walking! RIVER%%%"])
    assert sorted(seen) == ["river", "walking"]
    for t in SPY_TEXTS:
        same_ids(ids, [t])


@pytest.mark.parametrize("part", [1, 40, 10**6])
def test_word_ids_of_new_words_in_parts(part, monkeypatch):
    """Latin words in any case and signs of any number behind them, learned over several calls and in parts of a call."""
    monkeypatch.setattr(packing, "SLICE_BYTES", part, raising=False)
    rnd, ids = random.Random(5), packing.WordIds(WORDS)
    for _ in range(6):
        words = ["".join(rnd.choices("abcdeÀÉñßçøABCÿŸǅȺª", k=rnd.randrange(1, 4))) + "".join(rnd.choices(".,!%\"'", k=rnd.choice([0, 0, 1, 3, 8, 9, 20]))) for _ in range(1500)]
        same_ids(ids, [" ".join(words), " ".join(words[:700]), "", ".", "....... . ,"])


@pytest.mark.parametrize("docs", [3, 512])
def test_packing(spark, docs, monkeypatch):
    rnd = random.Random(4)
    texts = dict(TEXTS) | {100 + i: " ".join(prose(rnd, rnd.randrange(1, 900), 300)) for i in range(60)}
    df = frame(spark, [*texts.items(), (3, texts[3])]).repartition(2)
    if docs < 512:
        monkeypatch.setattr(packing, "SHARD_DOCS", docs)
    rows = packing.pack(df).collect()
    pieces_of, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces_of[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert pieces_of.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array([*tokenizer(WORDS).encode(t or "", add_special_tokens=False).ids, packing.END], "<u4")
        own = sorted(pieces_of[i], key=lambda r: r.start)
        if i == 3:  # the repeated row
            assert sum(r.length for r in own) == 2 * len(ids)
            continue
        at = 0
        for r in own:
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert total & (total - 1) == 0 and total <= packing.WINDOW
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    assert packing.pack(df.where("false")).count() == 0


def test_neighbours_share_words():
    """The best unused neighbour is the one of highest BM25."""
    rnd = np.random.default_rng(0)
    docs = [rnd.integers(0, 50, rnd.integers(5, 60)).astype(np.uint32) for _ in range(40)]
    index = packing.Index(docs)
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(50)}

    def bm25(q, d):
        out = 0.0
        for t in set(q.tolist()) & set(d.tolist()):
            tf = (d == t).sum()
            out += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        return out

    free = np.arange(1, n)
    got = index.ranked(0, free, 5)
    want = sorted(free, key=lambda i: (-bm25(docs[0], docs[i]), i))
    assert got.tolist()[:5] == want[:5]


def test_index_drops_used_documents():
    """Scores of free documents stay those in the whole shard, and entries of used ones are read no more."""
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, 400, rnd.integers(5, 90)).astype(np.uint32) for _ in range(120)]
    index = packing.Index(docs)
    entries = len(index.owner)
    free = np.arange(120)
    while len(free) > 8:
        free = np.sort(rnd.choice(free, len(free) - 7, replace=False))
        doc = int(rnd.integers(0, 120))
        assert index.ranked(doc, free, 5).tolist() == packing.Index(docs).ranked(doc, free, 5).tolist()
        assert index.ranked(doc, free, 5).tolist()[:3] == naive_bm25(docs, doc, free)[:3]
    assert len(index.owner) < entries / 4


def naive_bm25(docs, query, free):
    n, mean = len(docs), np.mean([len(d) for d in docs])
    score = dict.fromkeys(free.tolist(), 0.0)
    for t in np.unique(docs[query]):
        df = sum(t in d for d in docs)
        for i in score:
            tf = (docs[i] == t).sum()
            score[i] += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
    return sorted(score, key=lambda i: (-score[i], i))


def test_neighbours_reach_over_a_thousand_rows(spark):
    """A seed finds its near copy 900 rows on in the same task."""
    rnd = random.Random(7)
    texts = {i: " ".join("".join(rnd.choices("abcdefghijklmnoprstuvwy", k=6)) for _ in range(100)) for i in range(1000)}
    texts[900] = texts[0] + " tail"
    rows = packing.pack(frame(spark, texts).coalesce(1)).where("doc_id IN (0, 900)").collect()
    assert {r.sequence_id for r in rows if r.doc_id == 0} & {r.sequence_id for r in rows if r.doc_id == 900}


def test_neighbours_come_from_all_of_the_table(spark):
    """Texts that share words meet in one window wherever they stand: near copies at both ends of many files."""
    rnd = random.Random(17)
    pools = [["".join(rnd.choices("abcdefghijklmnoprstuvwy", k=7)) for _ in range(60)] for _ in range(12)]
    texts = {i: " ".join(rnd.choices(pools[i % 12], k=120)) for i in range(600)}
    df = frame(spark, texts).repartitionByRange(8, "doc_id")
    rows = packing.pack(df).collect()
    windows = defaultdict(set)
    for r in rows:
        windows[r.sequence_id].add(r.doc_id % 12)
    assert sum(map(len, windows.values())) < 2.5 * len(windows)
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if not r.start)


def test_lexical_keys():
    keys = packing.lexical_keys(pa.array([None, "", "a b", "a b c", "longer words here", "here words longer longer a"]))
    assert [len(k) for k in keys] == [6] * packing.KEYS
    assert all(k[0] == k[1] == 0 and k[4] == k[5] != 0 and k[2] != 0 for k in keys)
