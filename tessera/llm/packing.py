"""Lexical retrieval packing: BM25 neighbours of a seed fill its window.

Documents are dealt out by what they say: each gets the minima of KEYS hashes over its longer words, and the order by
these minima, cut into ranges, brings documents that share words side by side, wherever in the table they stand. Each
task tokenises its range and packs it shard by shard. A shard is a bounded run of that order with an inverted index over
token ids. A seed starts a window; BM25 with the seed as query ranks the shard's unused documents, and the best of them
fill the window in turn. The document that crosses the window's end is cut there and its rest opens the next window. So
every window is full but the last one of a task, which is cut at powers of two: it needs no padding. Windows never cross
tasks. The order is total but for rows that are equal, and ranges are cut from a written table, so a task that runs
again gives the same windows under the same numbers.

NULL and empty texts are documents of the end token alone. Repeated rows are packed each; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from tessera.llm.shared import SLICE_BYTES, documents, fixed, kept_tables, map_arrow, save, slices, trim
from tessera.llm.vocabularies import tokenizer
from tessera.llm.words import mix
from tessera.llm.words import words as split

WINDOW, END = 4096, 2
#: Documents and tokens of one shard's index at most; a longer document makes a shard of its own.
SHARD_DOCS, SHARD_TOKENS = 1024, 1_500_000
K1, B = 1.2, 0.75
#: Share of an index's documents below which it drops the used ones.
KEEP = 0.8
#: ASCII signs that the tokenizer's pattern takes as one run behind a letter (the apostrophe begins endings).
SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Below it lie Latin letters, each with its accents in one character, so that lower case and normal form don't interact.
LATIN_END = "\u0250"
#: Signs that are split off a word at once; a word with more of them goes the slower way.
MOST_SIGNS = 8
#: Words whose ids a process keeps; beyond it the memory is emptied, results stay the same.
REMEMBERED = 1_000_000
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def plain_letters() -> tuple[np.ndarray, np.ndarray]:
    """For each character below LATIN_END and one more for all others: whether it is a letter whose lower case is one such
    letter in normal form, and that lower case. Words of such letters alone fold letter by letter."""
    plain, low = np.zeros(ord(LATIN_END) + 1, bool), np.zeros(ord(LATIN_END) + 1, np.uint32)
    for i in range(ord(LATIN_END)):
        c = chr(i).lower()
        plain[i] = chr(i).isalpha() and len(c) == 1 and c < LATIN_END and c.isalpha() and c == c.lower() and is_normalized("NFC", c)
        low[i] = ord(c) if plain[i] else i
    return plain, low


PLAIN, LOW = plain_letters()
IS_SIGN = np.isin(np.arange(256), np.frombuffer(SIGNS.encode(), np.uint8))


def spread(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at `at`, one run after the other."""
    ends = np.cumsum(sizes)
    places = np.repeat(at - (ends - sizes), sizes)
    places += np.arange(len(places))
    return places


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted table, and whether it does."""
    place = np.searchsorted(table, keys)
    known = place < len(table)
    known[known] = table[place[known]] == keys[known]
    return place, known


#: Hashes whose minima order the documents; bytes of the words that count, if a text has such.
KEYS, LONG_WORD = 3, 5
FLIPS = fixed(41, KEYS)


class WordIds:
    """Token ids of whole texts, remembered by word.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its words in a row.
    Words are told apart by 64-bit hashes (words.py). Case is folded, and signs behind a letter are split off, where
    that is surely what the tokenizer does. A text that spells a special token is encoded as a whole.
    """

    def __init__(self, vocabulary: str):
        self.one = tokenizer(vocabulary)
        self.ends = np.array([(self.one.id_to_token(i) or "").endswith("</w>") for i in range(self.one.get_vocab_size())])
        self.special = [t.content for t in self.one.get_added_tokens_decoder().values()]
        self.bare = Tokenizer(self.one.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.signs: dict[int, tuple[int, int]] = {}

    def raw(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.one.encode_batch_fast(words, add_special_tokens=False)]

    def store(self, ids: np.ndarray) -> int:
        """Put ids at the end of the pool; where they begin."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def store_all(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the ids of each."""
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        return self.store(np.frombuffer(b"".join(raws), np.uint32)) + np.cumsum(sizes) - sizes, sizes

    def plain(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the ids of words of folded plain letters, each followed by a blank. They pass the normaliser
        unchanged and end at an end-of-word piece each, so they share texts and go to the same model without normaliser
        and pattern."""
        text = codes.astype("<u4", copy=False).tobytes().decode("utf-32-le")
        cuts = [0, *ends[1023::1024].tolist()]
        if cuts[-1] < len(text):
            cuts.append(len(text))
        at, sizes = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        texts = [text[i : j - 1] for i, j in zip(cuts, cuts[1:], strict=False)]
        for k, e in enumerate(self.bare.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            own = slice(1024 * k, min(len(ends), 1024 * (k + 1)))
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == own.stop - own.start and last[-1] == len(ids):
                sizes[own] = np.diff(last, prepend=0)
                at[own] = self.store(ids) + last - sizes[own]
            else:
                at[own], sizes[own] = self.store_all(self.raw(texts[k].split(" ")))
        return at, sizes

    def other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the ids of any words, one by one."""
        parts = []
        for w in words:
            c = w.rstrip(SIGNS)
            if not c or not c[-1].isalpha() or not normalize("NFC", c[-1].lower()).isalpha():  # some letters become one with a mark
                c = w
            parts.append((c.lower() if c.isascii() or max(c) < LATIN_END and "İ" not in c else c, w[len(c) :]))
        each = list({c for c, _ in parts}.union(t for _, t in parts if t))
        known = dict(zip(each, self.raw(each), strict=True))
        return self.store_all([known[c] + known[t] if t else known[c] for c, t in parts])

    def of_signs(self, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the ids of runs of signs, each as the bytes of a number."""
        runs, which = np.unique(signs, return_inverse=True)
        new = [r for r in runs.tolist() if r not in self.signs]
        self.signs.update(zip(new, zip(*(x.tolist() for x in self.store_all(self.raw([r.to_bytes(MOST_SIGNS, "little").rstrip(b"\0").decode() for r in new]))), strict=True), strict=True))
        found = np.array([self.signs[r] for r in runs.tolist()], np.int64).reshape(-1, 2)[which]
        return found[:, 0], found[:, 1]

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Remember the ids of new words: their sorted hashes, and where their bytes lie in data. A plain word is encoded
        once without the signs behind it, whatever these are, and remembered so, too."""
        cut, signs = ends.copy(), np.zeros(len(keys), np.uint64)
        left = np.arange(len(keys))
        for _ in range(MOST_SIGNS):
            left = left[cut[left] > starts[left]]
            left = left[IS_SIGN[data[cut[left] - 1]]]
            cut[left] -= 1
            signs[left] = signs[left] << np.uint64(8) | data[cut[left]]
        joined = np.full(int((cut - starts).sum()) + len(keys), 32, np.uint8)
        blank = np.cumsum(cut - starts + 1) - 1
        inside = np.ones(len(joined), bool)
        inside[blank] = False
        joined[inside] = data[spread(starts, cut - starts)]
        codes = np.frombuffer(joined.tobytes().decode().encode("utf-32-le"), "<u4")
        capped = np.minimum(codes, ord(LATIN_END))
        stops = np.flatnonzero(codes == 32) + 1
        bad = np.concatenate([[0], np.cumsum(~PLAIN[capped])])[stops] - np.arange(1, len(keys) + 1)  # but for the blanks
        sizes = np.diff(stops, prepend=0)
        fast = (np.diff(bad, prepend=0) == 0) & (sizes > 1)

        at, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slow = np.flatnonzero(~fast)
        if len(slow):
            at[slow], length[slow] = self.other([data[a:b].tobytes().decode() for a, b in zip(starts[slow].tolist(), ends[slow].tolist(), strict=True)])
        new_keys, new_at, new_length = [keys], [at], [length]
        fast = np.flatnonzero(fast)
        if len(fast):
            codes = LOW[capped[spread(stops[fast] - sizes[fast], sizes[fast])]]
            stops, sizes = np.cumsum(sizes[fast]), sizes[fast]
            text = codes.tobytes().decode("utf-32-le")
            cores, first, which = np.unique(split(pa.array([text], pa.large_string())).hashes, return_index=True, return_inverse=True)
            place, known = find(self.keys, cores)
            core_at, core_length = np.zeros(len(cores), np.int64), np.zeros(len(cores), np.int64)
            core_at[known], core_length[known] = self.at[place[known]], self.sizes[place[known]]
            first = first[~known]
            if len(first):
                core_at[~known], core_length[~known] = self.plain(codes[spread(stops[first] - sizes[first], sizes[first])], np.cumsum(sizes[first]))
            at[fast], length[fast] = core_at[which], core_length[which]
            signed = fast[signs[fast] > 0]
            if len(signed):
                sign_at, sign_length = self.of_signs(signs[signed])
                both = np.stack([length[signed], sign_length], 1)
                ids = self.pool[spread(np.stack([at[signed], sign_at], 1).ravel(), both.ravel())]
                length[signed] = both.sum(1)
                at[signed] = self.store(ids) + np.cumsum(length[signed]) - length[signed]
            fresh = ~known & ~find(keys, cores)[1]
            new_keys.append(cores[fresh])
            new_at.append(core_at[fresh])
            new_length.append(core_length[fresh])
        keys = np.concatenate(new_keys)
        order = np.argsort(keys)
        to = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, to, keys[order])
        self.at = np.insert(self.at, to, np.concatenate(new_at)[order])
        self.sizes = np.insert(self.sizes, to, np.concatenate(new_length)[order])

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text."""
        w = split(texts, lower=True)
        encoded = pc.dictionary_encode(pa.array(w.hashes))
        code, distinct = np.asarray(encoded.indices), np.asarray(encoded.dictionary)
        if len(self.keys) + len(distinct) > REMEMBERED:
            self.forget()
        order = np.argsort(distinct)
        ordered = distinct[order]
        place, known = find(self.keys, ordered)
        if not known.all():
            first = np.zeros(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            own = first[order[~known]]
            part = np.cumsum(w.ends[own] - w.starts[own]) // SLICE_BYTES  # a long text's new words in several parts
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for a, b in zip(cuts, cuts[1:], strict=False):
                new = a + np.flatnonzero(~find(self.keys, ordered[~known][a:b])[1])
                if len(new):
                    self.learn(ordered[~known][new], w.data, w.starts[own[new]], w.ends[own[new]])
            place = np.searchsorted(self.keys, ordered)
        at, sizes = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        at[order], sizes[order] = self.at[place], self.sizes[place]
        sizes = sizes[code]
        ends = np.cumsum(sizes)
        flat = self.pool[spread(at[code], sizes)].astype("<u4", copy=False).tobytes()
        cuts = np.concatenate([[0], ends])[w.first].tolist()
        out = [flat[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for t in self.special:
            for i in np.flatnonzero(pc.match_substring(texts, t).fill_null(False)).tolist():
                out[i] = self.raw([texts[i].as_py()])[0]
        return out


@cache
def word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


class Index:
    """BM25 over token ids of a shard; documents are taken out as they are used."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        sizes = np.fromiter(map(len, docs), np.int64, n)
        flat, bits = np.concatenate(docs), n.bit_length()
        kind = np.uint32 if len(flat) and int(flat.max()) >> (32 - bits) == 0 else np.uint64
        both = flat.astype(kind) << kind(bits) | np.repeat(np.arange(n, dtype=kind), sizes)  # a token id and its document in one number
        both.sort()
        first = np.ones(len(both), bool)
        first[1:] = both[1:] != both[:-1]
        edges = np.flatnonzero(first)
        tf = np.diff(edges, append=len(both)).astype(np.float64)
        both = both[edges]
        self.owner = (both & kind((1 << bits) - 1)).astype(np.int64)
        _, df = np.unique(both >> kind(bits), return_counts=True)
        self.at = np.concatenate([[0], np.cumsum(df)])
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(sizes.mean(), 1))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.owner])
        self.terms = np.repeat(np.arange(len(df)), df)[np.argsort(self.owner, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.owner, minlength=n))])
        self.n = self.held = n

    def drop_used(self, free: np.ndarray) -> None:
        """Leave only the entries of free documents; their weights stay those in the whole shard."""
        left = np.zeros(self.n, bool)
        left[free] = True
        left = left[self.owner]
        self.owner, self.weight = self.owner[left], self.weight[left]
        self.at = np.concatenate([[0], np.cumsum(left)])[self.at]
        self.held = len(free)

    def ranked(self, doc: int, free: np.ndarray, want: int) -> np.ndarray:
        """Free documents by falling score for the whole document as query (each term once), ties by place; a few more than wanted.
        A document that was not free once is not free later."""
        if len(free) < KEEP * self.held:
            self.drop_used(free)
        rows = self.terms[self.first[doc] : self.first[doc + 1]]
        a = self.at[rows]
        places = spread(a, self.at[rows + 1] - a)
        score = np.bincount(self.owner[places], self.weight[places], self.n)
        own = score[free]
        if len(free) > want:
            top = np.argpartition(-own, want - 1)[:want]
            cut = own[top].min()
            top = np.flatnonzero(own >= cut)
        else:
            top = np.arange(len(free))
        return free[top[np.lexsort((free[top], -own[top]))]]


class Packer:
    """Windows of one task. Pieces come out as tuples in the order of SCHEMA."""

    def __init__(self, task: int):
        self.sequence = task << 32
        self.fill = 0
        self.open: list[tuple[int, int, int, bytes]] = []  # pieces of the window not yet full: doc, start, doc_tokens, bytes
        self.out: list[tuple] = []

    def add(self, doc: int, ids: bytes) -> bool:
        """Put the document at the end; whether it began or went on in a fresh window, as its seed."""
        n, at, fresh = len(ids) // 4, 0, self.fill == 0
        while at < n:
            take = min(n - at, WINDOW - self.fill)
            self.open.append((doc, at, n, ids[4 * at : 4 * (at + take)]))
            at += take
            self.fill += take
            if self.fill == WINDOW:
                self.close()
                fresh = at < n
        return fresh and self.fill > 0

    def close(self) -> None:
        offset = 0
        for doc, start, n, raw in self.open:
            self.out.append((doc, start, len(raw) // 4, zlib.crc32(raw), n, self.sequence, offset))
            offset += len(raw) // 4
        self.sequence += 1
        self.open, self.fill = [], 0

    def finish(self) -> None:
        """Cut the last window into powers of two, the largest first."""
        rest, left = self.open, self.fill
        self.open, self.fill = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc, start, n, raw = rest.pop(0)
                take = min(room, len(raw) // 4)
                self.open.append((doc, start, n, raw[: 4 * take]))
                room -= take
                if 4 * take < len(raw):
                    rest.insert(0, (doc, start + take, n, raw[4 * take :]))
            self.close()

    def shard(self, docs: list[tuple[int, bytes]]) -> None:
        """Pack a shard: each seed is followed by its best unused neighbours until its window is full."""
        raws = [raw for _, raw in docs]
        if len(docs) == 1:
            self.add(*docs[0])
            return
        index = Index([np.frombuffer(r, np.uint32) for r in raws])
        free = np.ones(len(docs), bool)
        mean = max(1, sum(map(len, raws)) // 4 // len(raws))
        seed, next_first = None, 0
        while True:
            if seed is None:  # the first unused document opens or goes on with the window
                while next_first < len(docs) and not free[next_first]:
                    next_first += 1
                if next_first == len(docs):
                    return
                seed = next_first
                free[seed] = False
                if not self.add(*docs[seed]) and not self.fill:
                    seed = None
                    continue
            rest = np.flatnonzero(free)
            if not len(rest):
                return
            ranked, seed = index.ranked(seed, rest, 2 + 2 * (WINDOW - self.fill) // mean), None
            for d in ranked.tolist():
                free[d] = False
                before = self.sequence
                self.add(*docs[d])
                if self.sequence != before:  # the window is full; what crossed its end is the next seed
                    seed = d if self.fill else None
                    break


def lexical_keys(texts: pa.Array) -> list[np.ndarray]:
    """For each text the least of each of KEYS hashes over its words of LONG_WORD bytes or more, or over all if it has none; 0 without words."""
    w = split(texts, lower=True)
    long = w.ends - w.starts >= LONG_WORD
    some = np.concatenate([[0], np.cumsum(long)])[w.first]
    counts = np.repeat(np.diff(some), np.diff(w.first))
    used = np.flatnonzero(long | (counts == 0))
    owner = np.searchsorted(w.first, used, "right") - 1
    full, first = np.unique(owner, return_index=True)
    out = []
    for flip in FLIPS:
        key = np.zeros(len(texts), np.int64)
        if len(full):
            key[full] = np.minimum.reduceat(mix(w.hashes[used] ^ flip), first).view(np.int64)
        out.append(key)
    return out


def dealt(docs: DataFrame) -> DataFrame:
    """doc_id and text in ranges of the order by lexical keys; of several ranges each is a partition."""
    names = [f"k{i}" for i in range(KEYS)]

    def run(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "text": part.column("text")} | dict(zip(names, lexical_keys(part.column("text")), strict=True))

    keyed = save(map_arrow(documents(docs), run, "doc_id bigint, text string, " + ", ".join(f"{n} bigint" for n in names)), "keyed")
    order = [*names, "doc_id"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Pieces of all documents in windows; see SCHEMA. sequence_id: task in the high half, window in the low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer = word_ids(vocabulary), Packer(TaskContext.get().partitionId())
        held: list[tuple[int, bytes]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for part in slices(batch):
                end = np.array([END], "<u4").tobytes()
                for doc, raw in zip(part.column("doc_id").to_pylist(), known.ids(part.column("text")), strict=True):
                    if held and (len(held) == SHARD_DOCS or size + len(raw) // 4 > SHARD_TOKENS):
                        packer.shard(held)
                        held, size = [], 0
                        yield emit()
                    held.append((doc, raw + end))
                    size += len(raw) // 4 + 1
        if held:
            packer.shard(held)
        packer.finish()
        yield emit()
        trim()

    spark = docs.sparkSession
    with kept_tables(spark) as tables:
        pieces = save(dealt(docs).mapInArrow(run, SCHEMA), "pieces")
        tables.keep(pieces)
    return pieces
