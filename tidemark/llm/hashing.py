"""Vectorised hashing of whole batches of texts: words, word shingles and byte n-grams, without a Python loop per word.

All texts of a chunk are laid end to end in one byte array. A polynomial prefix hash of that array gives the hash of any
substring with one subtraction and one multiplication, so every word of the chunk is hashed at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Longer words are hashed by a digest: long ones can be made whose polynomial hashes are equal.
_SHORT = 32
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)

#: ASCII white space ends a word.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters ends a word; bytes of longer characters belong to words.
NON_LETTERS = np.ones(256, dtype=bool)
NON_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values; the result is as good as random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from mixed 64-bit values."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def chunks(texts: Sequence[str | None], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about ``limit`` characters each; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            size = max(n, 2 * len(_powers))
            p, q = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            p[0] = q[0] = 1
            _powers, _inverses = np.cumprod(p), np.cumprod(q)


class Prefix:
    """Prefix hash of a sequence of small numbers; ``at(start, end)`` hashes the slices."""

    def __init__(self, values: np.ndarray):
        _grow(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers[: len(values)], out=self._sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * _inverses[start]


def layout(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, each followed by a line feed, and where each text starts (one more at the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8) if parts else np.zeros(0, np.uint8), offsets


class Words:
    """The words of some texts: hash, place in the byte array, and the first word of each text (one more at the end)."""

    def __init__(self, texts: Sequence[str | None], separators: np.ndarray = SPACES, lower: bool = False):
        raw, offsets = layout(texts)
        inner = ~separators[raw]
        edge = np.diff(np.concatenate([[False], inner, [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.prefix = Prefix(LOWER[raw] if lower else raw)
        self.hash = mix(self.prefix.at(self.start, self.end))
        for i in np.flatnonzero(self.end - self.start > _SHORT).tolist():
            word = raw[self.start[i]:self.end[i]]
            self.hash[i] = int.from_bytes(hashlib.blake2b((LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
        self.first = np.searchsorted(self.start, offsets)


def shingles(texts: Sequence[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in order, and the first one of each text (one more at the end).

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    words = Words(texts)
    counts = np.diff(words.first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=first[1:])
    at = np.repeat(words.first[:-1] - first[:-1], n) + np.arange(first[-1])
    left = np.repeat(words.first[1:], n) - at  # words up to the end of the text
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([words.hash, np.zeros(size, np.uint64)])
    with np.errstate(over="ignore"):
        for j in range(size):
            step = padded[at + j] * np.uint64(_BASE * (2 * j + 1) & (1 << 64) - 1)
            out += np.where(left > j, step, np.uint64(0)) if size > 1 else step
    return mix(out + np.uint64(size)), first


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets given as arrays of hashes; 0 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - common
    return common / total if total else 0.0
