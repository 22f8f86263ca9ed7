"""SentencePiece encoding and decoding as a weighted transducer and its shortest path.

Compiled: the normaliser (mark at the front, space to mark), the pieces as arcs, and byte fallback for characters that
no piece spells. The model's scores rank its merges, they are no probabilities that could be added up along a path. So
a state is the last piece, and an arc weighs nothing if its piece may follow that one, which is if the model's merges
leave the two as they are when their letters stand alone, and infinitely much if not; these weights are made when they
are first met. The merges of a whole part leave pieces of which all neighbours may follow each other, and no others do
so: the shortest path in the tropical semiring over the composition is the one of weight 0. It is searched with the
longest arcs first. A place that a path of weight 0 reaches has one such path only, so no place is left twice.

No piece holds a mark behind another character, and marks join each other last of all; so a text falls apart before
each run of marks, and equal parts share one search. A mark that the text itself holds goes through byte fallback:
decoding gives every text back exactly. Texts without such a mark get the model's own ids.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import documents, map_arrow
from tessera.llm.vocabularies import SPACE, pieces, sentencepiece_model

#: Stands for a mark of the text itself while parts are cut; a private code point is escaped the same way.
LITERAL = "\ue000"
#: Parts that a process keeps in each of two generations, and weights; beyond it the older ones go, results stay the same.
REMEMBERED = 400_000


class Transducer:
    def __init__(self, vocabulary: str):
        model = sentencepiece_model(vocabulary)
        self.pieces = pieces(vocabulary)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        plain = [i for i in range(len(self.pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.arcs = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        inner = [p for p in self.arcs if SPACE in p[1:]]
        if any(p.strip(SPACE) for p in inner) or SPACE not in self.arcs:
            raise ValueError("a piece holds a word mark behind another character")
        if inner and max(self.score[p] for p in inner) >= min((x for p, x in self.score.items() if len(p) > 1 and p not in inner), default=0):
            raise ValueError("marks join each other before they join words")
        self.cut = self.boundaries()
        self.prefixes = {p[:k] for p in self.arcs for k in range(1, len(p) + 1)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.weights: dict[tuple[str, str], bool] = {}
        self.spelled = [p.encode().replace(SPACE.encode(), b" ") for p in self.pieces]
        for b, i in self.bytes.items():
            self.spelled[i] = bytes([b])
        for i in range(len(self.pieces)):
            if model.is_control(i):
                self.spelled[i] = b""

    def boundaries(self) -> re.Pattern:
        """Parts of a text that no piece crosses: they end before marks, and, where no piece joins them, around line ends and behind the letters before a sign."""
        line = "" if any("\n" in p and len(p) > 1 for p in self.arcs) else "\n"
        joined = {y for p in self.arcs for x, y in zip(p, p[1:], strict=False) if x.isalpha()}
        signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined)
        letters = f"{SPACE}*[^\\W\\d_{SPACE}]+(?=[{signs}])|" if signs else ""
        return re.compile(f"{letters}{SPACE}*[^{SPACE}{line}]+|{SPACE}+|\n")

    def merged(self, letters: str) -> list[str]:
        """What the model's merges leave of the letters: again and again the neighbours that make the piece of highest score, the first of equals."""
        n = len(letters)
        parts: list[str] = list(letters)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score = self.score
        queue = [(-score[x], i, x) for i in range(n - 1) if (x := parts[i] + parts[i + 1]) in score]
        heapq.heapify(queue)
        while queue:
            _, i, x = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != x:
                continue  # one of the two has been merged since
            parts[i], parts[j] = x, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (y := x + parts[k]) in score:
                    heapq.heappush(queue, (-score[y], i, y))
            if (h := before[i]) >= 0 and (y := parts[h] + x) in score:
                heapq.heappush(queue, (-score[y], h, y))
        return [p for p in parts if p]

    def follows(self, last: str, piece: str) -> bool:
        """Whether the arc's weight is 0: the merges leave the two pieces (or at the start the one) as they are."""
        found = self.weights.get((last, piece))
        if found is None:
            if len(self.weights) > REMEMBERED:
                self.weights.clear()
            found = self.weights[last, piece] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return found

    def outgoing(self, part: str, i: int) -> list[str]:
        """Arcs from a place, the longest last: pieces, and a character that no piece spells by itself."""
        out = [] if part[i] in self.arcs else [part[i]]
        j, n = i + 1, len(part)
        while j <= n and (s := part[i:j]) in self.prefixes:
            if s in self.arcs:
                out.append(s)
            j += 1
        return out

    def shortest(self, part: str) -> list[str]:
        """The arcs of the path of weight 0 through the lattice of one part."""
        n, at, last = len(part), 0, ""
        left, path, dead = [self.outgoing(part, 0)], [], set()
        while at < n:
            options = left[-1]
            while options:
                s = options.pop()
                if at + len(s) not in dead and self.follows(last, s):
                    path.append(s)
                    at, last = at + len(s), s
                    left.append(self.outgoing(part, at) if at < n else [])
                    break
            else:  # no way on from here
                dead.add(at)
                left.pop()
                at -= len(path.pop())
                last = path[-1] if path else ""
        return path

    def spell(self, arcs: list[str]) -> list[int]:
        out: list[int] = []
        for s in arcs:
            piece = self.arcs.get(s)
            if piece is None:
                out.extend(self.bytes[b] for b in (SPACE if s == LITERAL else s).encode())
            else:
                out.append(piece)
        return out

    def part_ids(self, part: str) -> bytes:
        """Little-endian ids of a part: of several marks the last joins the word, unless its path leaves it alone."""
        word = part.lstrip(SPACE)
        marks = len(part) - len(word)
        arcs = self.shortest(SPACE * (marks > 0) + word) if word else []
        if not word or marks > 1:
            if arcs and arcs[0] == SPACE:
                arcs = [*self.merged(SPACE * marks), *arcs[1:]]
            else:
                arcs = [*self.merged(SPACE * (marks - bool(word))), *arcs]
        return np.array(self.spell(arcs), "<u4").tobytes()

    def learn(self, parts: set[str]) -> None:
        """Remember the ids of new parts; those not met for long are forgotten."""
        new = parts.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.older = {}, self.known
            new = parts
        known, older = self.known, self.older
        for p in new:
            ids = older.get(p)
            known[p] = self.part_ids(p) if ids is None else ids

    def parts(self, text: str) -> list[str]:
        """The normalised text, cut before each run of marks."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, LITERAL)
        return self.cut.findall(SPACE + text.replace(" ", SPACE))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each whole text; none for an empty text."""
        cut = [[] if LITERAL in t else self.parts(t) for t in texts]
        self.learn(set().union(*cut))
        get = self.known.__getitem__
        return [self.with_literals(t) if LITERAL in t else b"".join(map(get, own)) for t, own in zip(texts, cut, strict=True)]

    def with_literals(self, text: str) -> bytes:
        """A text that holds the stand-in itself, which no piece spells either: cut there and spelled in bytes."""
        spelled = np.array([self.bytes[b] for b in LITERAL.encode()], "<u4").tobytes()
        out = []
        for k, s in enumerate(text.split(LITERAL)):
            out += [spelled] * (k > 0)
            out += map(self.part_ids, self.cut.findall((SPACE if not k else "") + s.replace(SPACE, LITERAL).replace(" ", SPACE)))
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text that was encoded: pieces spelled out without the mark at the front."""
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids.tolist()])[1:].decode(errors="replace")


@cache
def transducer(vocabulary: str) -> Transducer:
    return Transducer(vocabulary)


def encode(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids) of each whole text; NULL as empty."""

    def run(part: pa.RecordBatch) -> dict:
        t = transducer(vocabulary)
        return {"doc_id": part.column("doc_id"), "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in t.encode_all(part.column("text").to_pylist())]}

    return map_arrow(documents(docs), run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); NULL ids as none."""
    from collections.abc import Iterator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for b in batches:
            texts = [t.decode(np.array(x or [], np.uint32)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens, n_bytes (fallback tokens), ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoding gives the text)."""

    def run(part: pa.RecordBatch) -> dict:
        t = transducer(vocabulary)
        low, high = min(t.bytes.values()), max(t.bytes.values())
        out: dict = {k: [] for k in ("n_tokens", "n_bytes", "ids_crc32", "round_trip")}
        texts = part.column("text").to_pylist()
        for text, raw in zip(texts, t.encode_all(texts), strict=True):
            ids = np.frombuffer(raw, np.uint32)
            out["n_tokens"].append(len(ids))
            out["n_bytes"].append(int(((ids >= low) & (ids <= high)).sum()))
            out["ids_crc32"].append(zlib.crc32(raw))
            out["round_trip"].append(t.decode(ids) == text)
        return out | {"doc_id": part.column("doc_id")}

    return map_arrow(documents(docs), run, "doc_id bigint, n_tokens bigint, n_bytes bigint, ids_crc32 bigint, round_trip boolean")
