"""Word-piece lengths in one pass over each word, by a trie with failure links and popped-token counts.

Longest match first takes, at each place of a word, the longest piece. A node of the trie stands for characters read
and not yet given out; where no edge fits, its failure link leads to the node for what is left once the longest
pieces are popped, and their number is stored with it. So counting needs no pieces and no backing up. A word that
cannot be cut into pieces counts as one unknown token. Words are runs outside \\x20 and \\x09-\\x0D; NULL has none.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import documents, map_arrow
from tessera.llm.vocabularies import SPACE, pieces

DEAD = -1
#: Words whose counts a process keeps; beyond it the memory is emptied, results stay the same.
REMEMBERED = 400_000


class Automaton:
    """first: pieces that may begin a word; rest: pieces that may follow within it."""

    def __init__(self, first: set[str], rest: set[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # node 0 begins a word, node 1 goes on
        ends = {}
        for root, vocabulary in ((0, first), (1, rest)):
            for piece in vocabulary:
                node = root
                for c in piece:
                    to = self.edges[node].get(c)
                    if to is None:
                        to = len(self.edges)
                        self.edges[node][c] = to
                        self.edges.append({})
                    node = to
                if node > 1:
                    ends[node] = True
        n = len(self.edges)
        self.fail, self.pops = [DEAD] * n, [0] * n
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.edges[u].items():
                    below.append(v)
                    if v in ends:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    z, popped = self.fail[u], self.pops[u]
                    while z != DEAD and c not in self.edges[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z != DEAD:
                        self.fail[v], self.pops[v] = self.edges[z][c], popped
            level = below

    def length(self, word: str) -> int:
        """Pieces of the word; 0 if it has no cut into pieces."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = n = 0
        for c in word:
            to = edges[node].get(c)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node == DEAD:
                    return 0
                to = edges[node].get(c)
            node = to
        while node > 1:
            n += pops[node]
            node = fail[node]
            if node == DEAD:
                return 0
        return n if node == 1 else 0


def split_vocabulary(all_pieces: tuple[str, ...]) -> tuple[set[str], set[str]]:
    """Pieces with the word mark begin a word, those without follow; control and byte pieces are left out."""
    plain = [p for p in all_pieces if not (p.startswith("<") and p.endswith(">") and len(p) > 2)]
    return {p for p in plain if p.startswith(SPACE) and SPACE not in p[1:]}, {p for p in plain if SPACE not in p}


@cache
def automaton(vocabulary: str) -> Automaton:
    return Automaton(*split_vocabulary(pieces(vocabulary)))


class Lengths(dict):
    """word -> its pieces, 0 if unknown; filled as words come."""

    def __init__(self, vocabulary: str):
        self.length = automaton(vocabulary).length

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.length(SPACE + word.decode())
        return n


@cache
def lengths(vocabulary: str) -> Lengths:
    return Lengths(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each whole text."""

    def run(part: pa.RecordBatch) -> dict:
        known = lengths(vocabulary)
        n_words, n_tokens, n_unknown = [], [], []
        for text in part.column("text").to_pylist():
            counts = list(map(known.__getitem__, text.encode().split()))
            unknown = counts.count(0)
            n_words.append(len(counts))
            n_tokens.append(sum(counts) + unknown)
            n_unknown.append(unknown)
        return {"doc_id": part.column("doc_id"), "n_words": n_words, "n_tokens": n_tokens, "n_unknown": n_unknown}

    return map_arrow(documents(docs), run, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
