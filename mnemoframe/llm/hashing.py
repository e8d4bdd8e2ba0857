"""Word hashes of many texts at once, in numpy.

A batch of texts is one byte string in which every byte that isn't part of a word is a space. Words are hashed with a
polynomial over 64-bit values of their bytes: one running sum over the bytes gives all words, and one over the words all
shingles. Equal words give equal hashes; users of the hashes verify what they find.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(_STEP)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    raw: bytes  #: all texts, cleaned, each followed by a space, or by the byte that ends a piece
    start: np.ndarray  #: of each word, in raw
    end: np.ndarray
    first: np.ndarray  #: index of each text's (or piece's) first word, and at the end the number of words
    value: np.ndarray  #: hash of each word
    text: np.ndarray | None = None  #: index of each piece's text

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index at which it begins, hash) of each run of k words inside one text."""
        n = len(self.value) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(_BASE) + self.value[j : n + j]
        count = np.diff(self.first)
        room = np.repeat(self.first[1:] - k, count)[:n]  # the last index at which a shingle of this text can begin
        at = np.flatnonzero(np.arange(n) <= room)
        return at, mix(h[at])


def words_of(texts: list[str | None], table: bytes, cut: int | None = None) -> Words:
    """table: for bytes.translate; bytes outside words become a space, or the byte ``cut``, at which texts fall into pieces."""
    coded = [(t or "").encode("utf-8", "surrogatepass").translate(table) for t in texts]
    gap = b" " if cut is None else bytes([cut])
    raw = gap.join(coded) + gap
    a = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(a) + 1, np.int8)
    inside[1:] = a != 32 if cut is None else (a != 32) & (a != cut)
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_byte_values()[a] * powers(_BASE, len(a)), out=sums[1:])
    value = mix((sums[end] - sums[start]) * powers(_BASE_INV, len(a))[start] if len(start) else np.empty(0, np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])]) if coded else np.zeros(1, np.int64)
    if cut is None:
        return Words(raw, start, end, np.searchsorted(start, bounds), value)
    pieces = np.concatenate([[0], np.flatnonzero(a == cut) + 1]) if coded else np.zeros(1, np.int64)
    return Words(raw, start, end, np.searchsorted(start, pieces), value, np.searchsorted(bounds, pieces[:-1], "right") - 1)
