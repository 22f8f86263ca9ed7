"""Words of whole texts as 64-bit hashes, a batch at a time.

A word is a run of bytes outside \\x20 and \\x09-\\x0D. Its hash is a polynomial over random byte values, taken from
prefix sums, then mixed; texts are never turned into Python words. Two different words of one corpus share a hash with
a chance of about 2^-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tessera.llm.shared import fixed

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = fixed(11, 256)
BASE = int(fixed(12, 1)[0]) & ~7 | 5
U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all (splitmix64's finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i mod 2^64 for i < n."""
    size = max(BLOCK + 1, n)
    if size not in _powers:
        _powers.clear()
        made = []
        for b in (BASE, pow(BASE, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = made[0], made[1]
    return _powers[size]


@dataclass
class Words:
    """data: the batch's bytes; at: byte offset of each text (n + 1); starts, ends: bytes of each word; first: index of each text's first word (n + 1)."""

    data: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they all lie in its text."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        out = np.zeros(n - k + 1, np.uint64)
        for i, c in enumerate(fixed(13, k)):
            out += mix(self.hashes[i : n - k + 1 + i] ^ c) * c
        return np.concatenate([mix(out), np.zeros(k - 1, np.uint64)]), self.inside(k)

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in its text."""
        room = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hashes))
        return room >= k

    def rolling(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, whatever k, from prefix sums; 0 where they do not all lie in its text."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        if n >= k:
            up, down = powers(n + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hashes ^ VALUES[0]) * up[:n], dtype=np.uint64)])
            out[: n - k + 1] = mix((sums[k:] - sums[:-k]) * down[: n - k + 1]) | U(1)
            out[~self.inside(k)] = 0
        return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and n + 1 offsets; NULL is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, at = text_bytes(texts)
    parts = []
    a = 0
    while a < len(data):
        b = min(len(data), a + BLOCK)
        if b < len(data):  # cut where a text starts or at white space
            starts_here = np.searchsorted(at, b, "right")
            before = at[starts_here - 1]
            if before > a:
                b = int(before)
            else:
                gap = SPACE[data[a:b]]
                if gap.any():
                    b = a + int(np.flatnonzero(gap)[-1]) + 1
                else:
                    limit = int(at[starts_here]) if starts_here < len(at) else len(data)
                    more = SPACE[data[b:limit]]
                    b = b + int(more.argmax()) + 1 if more.any() else limit
        parts.append(_block(data, at, a, b, lower))
        a = b
    starts, ends, hashes = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts, strict=True) if parts else ((), (), ()), (np.int64, np.int64, np.uint64), strict=True))
    return Words(data, at, starts, ends, hashes, np.searchsorted(starts, at))


def _block(data: np.ndarray, at: np.ndarray, a: int, b: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = data[a:b]
    inside = np.empty(b - a + 1, bool)
    np.logical_not(SPACE[x], out=inside[:-1])
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cuts = at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a  # texts end without white space
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    stops = inside[:-1] & ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    stops[cuts] = inside[cuts]
    ends = np.flatnonzero(stops) + 1
    up, down = powers(b - a + 1)
    sums = np.zeros(b - a + 1, np.uint64)
    np.cumsum(VALUES[LOWER[x] if lower else x] * up[: b - a], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts + a, ends + a, hashes
