"""Language identification by unigram pieces, summed over all segmentations.

Each language has probabilities for the pieces of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. The probabilities are
fitted by expectation-maximisation (forward-backward) on a bounded sample of labelled rows. Words are lower-cased runs
of letters; cuts never cross words, so equal words share one computation. The sums are rescaled on their way, so words
of any length stay within doubles.

Bounds of what is learned from: LANGUAGES most frequent labels, about DOCS_PER_LANGUAGE documents each, of SAMPLE_CHARS
characters at most, and of them words of up to TAUGHT characters. Every text is scored whole. NULL ids are drawn and
scored like others.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import documents, map_arrow
from tessera.llm.vocabularies import SPACE, pieces

#: Labelled documents that a language is learned from; all if it has fewer.
DOCS_PER_LANGUAGE = 150
#: Labels that are learned at most, the most frequent ones; characters of a document, and of a word, that teaches.
LANGUAGES, SAMPLE_CHARS, TAUGHT = 500, 20_000, 400
ROUNDS, PRIOR, UNKNOWN = 2, 0.02, 1e-8
WORD = re.compile(r"[^\W\d_]+")
#: Places after which sums are rescaled.
RESCALE = 16
#: A text's log odds are scaled down to those of so many words, so that scores tell long texts apart too.
SCORED_WORDS = 40
REMEMBERED = 300_000


@dataclass
class Trie:
    """Pieces as a table: first[code point] and next[node, letter] give nodes, piece[node] the piece that ends there.

    Letters are the characters of pieces of several characters. size: number of pieces, which is also the row of an
    unknown character.
    """

    first: np.ndarray
    next: np.ndarray
    piece: np.ndarray
    letter: np.ndarray
    size: int
    width: int


@cache
def trie(vocabulary: str) -> Trie:
    plain = [p.lower() for p in pieces(vocabulary) if not (p.startswith("<") and p.endswith(">") and len(p) > 2)]
    known = {p for p in plain if SPACE not in p[1:] and p != SPACE}
    letters = {c: i for i, c in enumerate(sorted({c for p in known if len(p) > 1 for c in p}))}
    kept = sorted(known)
    letter = np.full(0x110000, len(letters), np.uint16)
    for c, i in letters.items():
        letter[ord(c)] = i
    first = np.full(0x110000, -1, np.int32)
    edges: dict[tuple[int, int], int] = {}
    ends: list[int] = []
    for row, p in enumerate([*kept, SPACE]):
        node = int(first[ord(p[0])])
        if node < 0:
            node = first[ord(p[0])] = len(ends)
            ends.append(-1)
        for c in p[1:]:
            to = edges.get((node, letters[c]))
            if to is None:
                to = edges[node, letters[c]] = len(ends)
                ends.append(-1)
            node = to
        ends[node] = row
    follow = np.full((len(ends), len(letters) + 1), -1, np.int32)
    for (node, c), to in edges.items():
        follow[node, c] = to
    return Trie(first, follow, np.array(ends, np.int32), letter, len(kept) + 1, max(map(len, kept)))


def lattices(words: list[str], vocabulary: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length together: their places in the list, and rows[word, start, size - 1] of pieces (-1: none)."""
    t = trie(vocabulary)
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w)].append(i)
    for n, members in by_length.items():
        if not n:
            continue
        points = np.frombuffer("".join([words[i] for i in members]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        letter = t.letter[points]
        rows = np.full((len(members), n, min(n, t.width)), -1, np.int32)
        for a in range(n):
            node = t.first[points[:, a]]
            at = np.flatnonzero(node >= 0)
            node = node[at]
            rows[at, a, 0] = t.piece[node]
            lone = rows[:, a, 0] < 0
            rows[lone, a, 0] = t.size
            for k in range(1, min(n - a, t.width)):
                node = t.next[node, letter[at, a + k]]
                on = node >= 0
                node, at = node[on], at[on]
                if not len(at):
                    break
                rows[at, a, k] = t.piece[node]
        yield np.array(members), rows


def forward(rows: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: sums over all segmentations of what lies before the place; in the type of p."""
    m, n, width = rows.shape
    alpha = np.zeros((m, n + 1, p.shape[1]), p.dtype)
    alpha[:, 0] = 1
    for a in range(n):
        for k in range(1, min(width, n - a) + 1):
            have = np.flatnonzero(rows[:, a, k - 1] >= 0)
            if len(have):
                alpha[have, a + k] += alpha[have, a] * p[rows[have, a, k - 1]]
    return alpha


def log_probabilities(rows: np.ndarray, p: np.ndarray) -> np.ndarray:
    """[word, language]: log of the sums over all segmentations. Only the places that pieces reach are held, and they
    are rescaled by their largest every RESCALE places."""
    m, n, width = rows.shape
    ahead = [np.zeros((m, p.shape[1])) for _ in range(width + 1)]
    ahead[0] += 1
    logs = np.zeros((m, p.shape[1]))
    for a in range(n):
        here = ahead[0]
        for k in range(1, min(width, n - a) + 1):
            have = np.flatnonzero(rows[:, a, k - 1] >= 0)
            if len(have):
                ahead[k][have] += here[have] * p[rows[have, a, k - 1]]
        ahead = [*ahead[1:], here]
        here[:] = 0
        if (a + 1) % RESCALE == 0:
            most = np.maximum.reduce(ahead)
            for x in ahead:
                x /= most
            logs += np.log(most)
    return logs + np.log(ahead[0])


def expected(rows: np.ndarray, weight: np.ndarray, p: np.ndarray, into: np.ndarray) -> None:
    """Add the expected piece counts of the weighted words (weight[word, language]) by forward-backward."""
    m, n, width = rows.shape
    alpha = forward(rows, p)
    beta = np.zeros_like(alpha)
    beta[:, n] = weight / alpha[:, n]
    for a in range(n - 1, -1, -1):
        for k in range(1, min(width, n - a) + 1):
            have = np.flatnonzero(rows[:, a, k - 1] >= 0)
            if len(have):
                own = rows[have, a, k - 1]
                step = p[own] * beta[have, a + k]
                np.add.at(into, own, (alpha[have, a] * step).astype(into.dtype))
                beta[have, a] += step


@dataclass
class Model:
    """languages by name; p[piece, language], the last piece standing for an unknown character."""

    languages: list[str]
    p: np.ndarray
    vocabulary: str


def fit(counts: list[tuple[str, str, int]], vocabulary: str) -> Model:
    """counts: (language, word, times)."""
    languages = sorted({x for x, _, _ in counts})
    place = {x: i for i, x in enumerate(languages)}
    weights: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for language, word, times in counts:
        if len(word) < TAUGHT:
            weights[SPACE + word][place[language]] += times
    words = sorted(weights)
    weight = np.array([weights[w] for w in words]).reshape(len(words), len(languages))
    size = trie(vocabulary).size + 1
    p = np.full((size, len(languages)), 1 / size)
    p[-1] = UNKNOWN
    made = list(lattices(words, vocabulary))
    for _ in range(ROUNDS):
        sums = np.full((size, len(languages)), PRIOR)
        for members, rows in made:  # long words' sums need a wider exponent
            expected(rows, weight[members], p if rows.shape[1] <= 32 else p.astype(np.longdouble), sums)
        sums[-1] = 0
        p = sums / sums.sum(0)
        p[-1] = UNKNOWN
    return Model(languages, p, vocabulary)


def sample_counts(docs: DataFrame, label: str, learn: Column, per_language: int) -> list[tuple[str, str, int]]:
    """Word counts of about per_language documents of each language (over all never more than twice that), those of least hash, ties by id and text."""
    rows = docs.where(learn & F.col(label).isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= SAMPLE_CHARS))
    most = rows.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES)
    sizes = {r.l: r.n for r in most.collect()}  # at most LANGUAGES rows
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.where(draw < share[F.col(label)]).select(F.col(label).alias("l"), "text", F.xxhash64("doc_id", "text").alias("h"))
    drawn = drawn.orderBy("h", "text", "l").limit(2 * per_language * len(sizes))
    words = drawn.select("l", F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("w")).where("w <> ''")
    counts = words.groupBy("l", "w").agg(F.count(F.lit(1)).alias("n")).collect()  # words of a sample bounded in documents and characters
    return sorted((r.l, r.w, r.n) for r in counts)


class Scorer:
    """Log probabilities of words by language, remembered within a process."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)))

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.at))
        if len(self.at) + len(new) > REMEMBERED:
            self.clear()
            new = list(words)
        scores = np.zeros((len(new), len(self.model.languages)))
        for members, rows in lattices([SPACE + w for w in new], self.model.vocabulary):
            scores[members] = log_probabilities(rows, self.model.p)
        n = len(self.at)
        while n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(new)] = scores
        self.at.update(zip(new, range(n, n + len(new)), strict=True))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        split = [WORD.findall(t.lower()) for t in texts]
        self.learn(set().union(*split))
        out = []
        for words in split:
            if not any(w.isalpha() for w in words) and not any(c.isalpha() for w in words for c in w):
                out.append(("und", 0.0))
                continue
            s = self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(0)
            e = np.exp((s - s.max()) * min(1.0, SCORED_WORDS / len(words)))
            out.append((self.model.languages[int(s.argmax())], float(e.max() / e.sum())))
        return out


def identify(docs: DataFrame, label: str = "lang", learn: Column | None = None, vocabulary: str = "piece_bpe_32k.model", per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text; `und` with score 0 without a letter, a text or a learned language.

    learn: which rows may teach; their labels are read nowhere else.
    """
    counts = sample_counts(docs, label, F.lit(True) if learn is None else learn, per_language)
    model = fit(counts, vocabulary) if counts else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces times languages: bounded by the vocabulary

    def run(part: pa.RecordBatch) -> dict:
        ids, texts = part.column("doc_id"), part.column("text").to_pylist()
        got = scorer(shared).predict(texts) if shared.value else [("und", 0.0)] * len(texts)
        return {"doc_id": ids, "lang_pred": [x for x, _ in got], "score": [s for _, s in got]}

    return map_arrow(documents(docs), run, "doc_id bigint, lang_pred string, score double")


_scorers: dict[int, Scorer] = {}


def scorer(shared) -> Scorer:
    """The process's scorer of a broadcast model; an older one is let go."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) is not None else id(shared.value)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(shared.value)
    return _scorers[key]
