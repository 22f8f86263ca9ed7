"""Secrets in whole texts: three fixed patterns, and strings that a public vocabulary finds hard to say.

Text that a byte-pair vocabulary was fitted on takes few tokens; random strings take many. A run of key-like
characters is a secret if it has few characters per token. Digests of known lengths, UUIDs, numbers and identifiers
made of words are excluded before the test. Spans are code points of the whole text, end exclusive; NULL counts as
empty. The added spans never overlap those of the patterns, which always stay.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import documents, map_arrow
from tessera.llm.vocabularies import tiktoken_encoding

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # greedy, so as [0-9a-f]+ with shorter matches dropped
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
HEXES = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Words of an identifier: one case or Capitalised, or a short number.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}")
SEPARATORS = re.compile(r"[-_+/=]")
#: A run of at most so many characters a token, and of so many tokens at least, is random.
CHARS_PER_TOKEN, MIN_TOKENS = 2.2, 8
#: So many letters of one case in a row are no identifier's word; as they may still be language, they need fewer characters a token.
LONG_PART, CHARS_PER_TOKEN_OF_LETTERS = 16, 1.9
MASK = "[SECRET]"


@cache
def _tokens(vocabulary: str):
    return tiktoken_encoding(vocabulary).encode_ordinary


def longest_part(run: str) -> int:
    return max(map(len, PART.findall(run)), default=0)


def excluded(run: str) -> bool:
    """Known digests, UUIDs, numbers, and identifiers whose parts are words; how hard a long part is to say, its tokens tell."""
    bare = run.strip("=-_/+")
    if len(bare) < 16 or bare.isdigit() or UUID.match(bare) or HEXES.match(bare) and len(bare) in DIGESTS:
        return True
    if longest_part(bare) >= LONG_PART:
        return False
    if all(len(PART.findall(x)) <= 2 for x in SEPARATORS.split(bare)):
        return True
    return len(PART.findall(bare)) <= 2 + len(bare) / 6  # words of about six characters; random strings change class sooner


def spans(text: str | None, vocabulary: str = "byte_bpe_50k.tiktoken") -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding, by start, then kind."""
    text = text or ""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = list(found)
    for m in RUN.finditer(text):
        if not excluded(m[0]) and not any(s < m.end() and m.start() < e for _, s, e in base):
            n = len(_tokens(vocabulary)(m[0]))
            limit = CHARS_PER_TOKEN_OF_LETTERS if longest_part(m[0]) >= LONG_PART else CHARS_PER_TOKEN
            if n >= MIN_TOKENS and len(m[0]) <= limit * n:
                found.append(("random", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each merged span replaced by MASK."""
    out, at = [], 0
    for _, s, e in found:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and found: array of (kind, start, end), one row a document."""

    def run(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "found": [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t, vocabulary)] for t in part.column("text").to_pylist()]}

    return map_arrow(documents(docs), run, "doc_id bigint, found array<struct<kind:string,start:bigint,end:bigint>>")


def mask(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The same rows and columns with secrets masked; NULL stays NULL, and a length column follows the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.schema
    arrow, names = to_arrow_schema(schema), schema.names

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index(text_column)).to_pylist()
            new = [t and masked(t, spans(t, vocabulary)) for t in texts]
            columns = list(batch.columns)
            columns[names.index(text_column)] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], names=names)

    out = docs.mapInArrow(run, schema)
    if length_column in names:
        out = out.withColumn(length_column, F.char_length(text_column).cast(schema[length_column].dataType))
    return out


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns: counts by kind, hash of the fixed patterns' spans, all spans."""

    def run(part: pa.RecordBatch) -> dict:
        found = [spans(t) for t in part.column("text").to_pylist()]
        counts = {f"n_{k}": [sum(x[0] == k for x in f) for f in found] for k in KINDS}
        base = [joined([x for x in f if x[0] != "random"]) for f in found]
        return {"doc_id": part.column("doc_id"), "base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base], "spans": [joined(f) for f in found]} | counts

    return map_arrow(documents(docs), run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint")
