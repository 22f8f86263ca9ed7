"""Toxicity by a weighted lexicon, matched in one pass by an Aho-Corasick automaton.

Text is folded first: lower case, look-alike letters of other scripts to Latin, digits and signs that stand for letters
inside words to those letters, all else but letters to blanks. Lexicon entries are word beginnings: those
that a bounded sample of labelled rows shows far oftener in toxic documents than in others, with their log odds
as weight; so inflected forms that the sample never held match too. Exception phrases (a lexicon word with a
neighbour, seen in harmless documents only) cancel the matches inside them. A text's weight, as a sum and for its length,
goes through a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import documents, map_arrow

#: Labelled rows that teach, for each label at most.
SAMPLE = {1: 1500, 0: 3000}
#: Longer texts do not teach, so that the sample has a bound in bytes too; they are scored like all others.
SAMPLE_CHARS = 20_000
#: Stem lengths; a stem is a word's beginning, or a whole word with its end.
SHORTEST, LONGEST_STEM = 3, 10
#: A stem's documents among toxic ones: share and number at least; its log odds, less their uncertainty, at least.
SHARE, DOCUMENTS, ODDS = 0.004, 4, 1.5

# Letters of other scripts that look like Latin ones (after lower-casing).
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ё": "e",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ɩ": "i", "ʀ": "r", "ꜱ": "s",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t"}
_TABLE = str.maketrans(LOOKALIKES)
#: Full-width and styled letters have one plain letter each in Unicode's compatibility forms.
_STYLED = re.compile("[Ａ-ｚ①-⓿\U0001d400-\U0001d7ff]")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SIGNS = re.compile(r"(?<=\S)[0-9@$!|€+](?=[^\W\d_])|(?<=[^\W\d_])[0-9@$|€+]|(?<!\S)[0-9@$€](?=[^\W\d_])")
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Folded words, one blank before and after each."""
    low = text.lower()
    if not low.isascii():
        if _INVISIBLE.search(low):
            low = _INVISIBLE.sub("", low)
        if _STYLED.search(low):
            import unicodedata

            low = _STYLED.sub(lambda m: unicodedata.normalize("NFKC", m[0]).lower(), low)
        low = low.translate(_TABLE)
    if _SIGNS.search(low):
        low = _SIGNS.sub(lambda m: SUBSTITUTES[m[0]] if m[0] in SUBSTITUTES else m[0], low)
        low = _SIGNS.sub(lambda m: SUBSTITUTES[m[0]] if m[0] in SUBSTITUTES else m[0], low)
    return f" {_OTHER.sub(' ', low).strip()} "


def stems(words: Iterable[str]) -> set[str]:
    """' ' + each beginning of each word, and ' ' + the whole word + ' '."""
    out = set()
    for w in words:
        out.add(f" {w} ")
        for k in range(SHORTEST, min(len(w), LONGEST_STEM) + 1):
            out.add(f" {w[:k]}")
    return out


@dataclass
class Model:
    """stems and exception phrases with weights (exceptions weigh nothing), and the curve's coefficients."""

    lexicon: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, float, float]

    def automaton(self):
        made = ahocorasick.Automaton()
        for s, w in self.lexicon.items():
            made.add_word(s, (len(s), w))
        for s in self.exceptions:
            made.add_word(s, (len(s), 0.0))
        if len(made):
            made.make_automaton()
        return made


def weight(folded: str, automaton) -> float:
    """Sum of the matched stems' weights, one for each word, but for those inside exception phrases."""
    if not len(automaton):
        return 0.0
    hits: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w:
            hits[start] = max(w, hits.get(start, 0.0))
        else:
            excused.append((start, end))
    if excused:
        excused.sort()
        firsts = [a for a, _ in excused]
        reach = list(accumulate((b for _, b in excused), max))  # how far the phrases up to each one go
        hits = {s: w for s, w in hits.items() if not (k := bisect_right(firsts, s)) or reach[k - 1] <= s}
    return sum(hits.values())


def features(folded: str, automaton) -> tuple[float, float]:
    """Log of the weight, and log of the weight a hundred words."""
    total = weight(folded, automaton)
    return math.log1p(total), math.log1p(100 * total / max(folded.count(" ") - 1, 1))


def surely(bad: int, all_bad: int, good: int, all_good: int) -> float:
    """Log odds that a document with the stem is toxic, less 1.3 of their standard errors."""
    return math.log((bad + 0.5) / (all_bad + 1) * (all_good + 1) / (good + 0.5)) - 1.3 * math.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))


def origin(folded: str) -> int:
    """The least hash of five words in a row: the same for most near copies."""
    w = folded.split()
    return min((zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))), default=0)


def fit(sample: list[tuple[str, int]]) -> Model:
    """sample: (text, toxic). Without both labels nothing is toxic."""
    folded = [(fold(t), y) for t, y in sample]
    once = {(origin(t), y): t for t, y in folded}  # copies of one text are one witness
    bad, good = [set(t.split()) for (_, y), t in once.items() if y], [set(t.split()) for (_, y), t in once.items() if not y]
    if not bad or not good:
        return Model({}, [], (-4.0, 0.0, 0.0))
    in_bad, in_good = Counter(), Counter()
    for w in bad:
        in_bad.update(stems(w))
    frequent = {s for s, n in in_bad.items() if n >= max(DOCUMENTS, SHARE * len(bad))}
    for w in good:
        in_good.update(stems(w) & frequent)
    odds = {s: surely(in_bad[s], len(bad), in_good[s], len(good)) for s in frequent}
    lexicon: dict[str, float] = {}
    taken: set[str] = set()  # the beginnings of chosen stems
    for s in sorted((s for s in frequent if odds[s] >= ODDS), key=lambda s: (-odds[s], len(s), s)):
        if s not in taken and not any(s[:k] in lexicon for k in range(SHORTEST + 1, len(s))):  # of a stem's forms the surest
            lexicon[s] = odds[s]
            taken.update(s[:k] for k in range(SHORTEST + 1, len(s)))
    phrases_bad, phrases_good = Counter(), Counter()
    plain = Model(lexicon, [], (0.0, 0.0, 0.0)).automaton()
    for text, y in folded:
        if len(plain):
            near = set()
            for end, (n, _) in plain.iter(text):
                a = end - n + 1
                b = text.index(" ", a + 1)
                c = text.find(" ", b + 1)
                if c > 0:
                    near.add(text[a : c + 1])
                z = text.rfind(" ", 0, a) if a else -1
                if z >= 0:
                    near.add(text[z : b + 1])
            (phrases_bad if y else phrases_good).update(near)
    exceptions = [p for p, n in phrases_good.items() if n >= 3 and not phrases_bad[p]]
    model = Model(lexicon, exceptions, (0.0, 0.0, 0.0))
    machine = model.automaton()
    x = np.array([(1.0, *features(t, machine)) for t, _ in folded])
    y = np.array([float(y) for _, y in folded])
    # both labels weigh the same, as the sample was drawn by label
    balance = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    c = np.zeros(3)
    for _ in range(30):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (balance * p * (1 - p))[:, None]).T @ x + np.diag([0.01, 0.1, 0.1]) * len(y) / 100
        c += np.linalg.solve(h, x.T @ (balance * (y - p)) - np.array([0.01, 0.1, 0.1]) * len(y) / 100 * c)
    return Model(lexicon, exceptions, tuple(c.tolist()))


def probability(model: Model, automaton, text: str) -> float:
    a, b = features(fold(text), automaton)
    c = model.curve
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * a + c[2] * b))))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> list[tuple[str, int]]:
    """Texts of a bounded number of labelled rows, those of least hash, ties by id and text; at most SAMPLE rows of a label are
    drawn, and where ids repeat twice as many texts reach the driver at most."""
    ids = None
    for value, n in SAMPLE.items():
        own = labels.where(learn & (F.col(label) == value)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = own if ids is None else ids.unionByName(own)
    texts = docs.where(learn).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.char_length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(ids), "doc_id")  # ids are bounded by SAMPLE
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text", "y").limit(2 * sum(SAMPLE.values())).select("text", "y").collect()
    return sorted((r.text, r.y) for r in rows)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None) -> DataFrame:
    """(doc_id, score) of each whole text, 0 to 1; NULL and empty texts have no matches. Labels are read in the sample only."""
    model = fit(sample(docs, labels, label, F.lit(True) if learn is None else learn))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # stems of a bounded sample

    def run(part: pa.RecordBatch) -> dict:
        model, machine = ready(shared)
        return {"doc_id": part.column("doc_id"), "score": [probability(model, machine, t) for t in part.column("text").to_pylist()]}

    return map_arrow(documents(docs), run, "doc_id bigint, score double")


_made: dict[int, tuple] = {}


def ready(shared) -> tuple:
    """The broadcast model with its automaton, which each process builds once."""
    model = shared.value
    if id(model) not in _made:
        _made.clear()
        _made[id(model)] = model, model.automaton()
    return _made[id(model)]
