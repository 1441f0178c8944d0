"""Pre-tokenization of a byte-level vocabulary in vectorised form, and a cache of encoded pieces.

``split`` finds the matches of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

from the classes of the code points alone: where a match starts depends on a code point and at most three neighbours.
The tests hold it against the pattern itself.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from tidemark.llm.hashing import Prefix, mix

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: The code points with the White_Space property.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """Class of every code point, made once in a process."""
    global _classes
    if _classes is None:
        kinds = {"L": _LETTER, "N": _NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)),
                            dtype=np.uint8, count=sys.maxunicode + 1)
        table[list(_WHITE)] = _SPACE
        _classes = table
    return _classes


def split(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined, the start of every piece (one more at the end), a hash of each piece, the first piece of each text
    (one more at the end). Pieces do not cross the border of two texts."""
    joined = "".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(code)
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=begin[1:])
    if not n:
        return joined, np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    kind = _class_table()[code]
    first = np.zeros(n + 1, dtype=bool)  # first code point of a text; the end counts as one
    first[begin] = True
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = _SPACE, kind[:-1]
    blank = code == 0x20
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = blank[:-1]
    blank_before &= ~first[:-1]
    edge = first[:-1].copy()  # a new text, or another class than before
    edge |= kind != before
    start = edge.copy()
    solid = kind != _SPACE
    start &= ~(solid & blank_before)  # a blank before a run belongs to the run
    # The last white space before a run of other classes is a piece of its own, or starts the run's piece.
    last = np.zeros(n, dtype=bool)
    last[:-1] = (kind[:-1] == _SPACE) & solid[1:]
    last &= ~first[1:]
    start |= last
    # Contractions: an apostrophe that starts a match, with its letters in the same text.
    marks = np.flatnonzero((code == 0x27) & start)
    if len(marks):
        room = np.searchsorted(begin, marks, side="right")
        room = begin[room] - marks  # code points up to the end of the text
        one = code[np.minimum(marks + 1, n - 1)]
        two = code[np.minimum(marks + 2, n - 1)]
        short = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
        pair = one.astype(np.uint64) << np.uint64(32) | two
        long = (room > 2) & np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        for where, width in ((marks[short], 2), (marks[long], 3)):
            for i in range(1, width):
                start[where + i] = False
            after = where + width
            after = after[after < n]
            # What follows starts a match; a blank that would have joined the next run is a start already.
            start[after] = True
    starts = np.flatnonzero(start)
    bounds = np.append(starts, n)
    hashes = mix(Prefix(code).at(bounds[:-1], bounds[1:]) + (bounds[1:] - bounds[:-1]).astype(np.uint64))
    return joined, bounds, hashes, np.searchsorted(starts, begin)


def different(joined: str, bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different piece, and the number of every piece's among them. Hashes only propose equal pieces: code points decide."""
    _, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size, like = np.diff(bounds), where[inverse]
    if (size == size[like]).all() and np.array_equal(code, code[np.repeat(bounds[like] - bounds[:-1], size) + np.arange(len(code))]):
        return where, inverse
    numbers: dict[str, int] = {}
    inverse = np.fromiter((numbers.setdefault(joined[a:b], len(numbers)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())),
                          dtype=np.int64, count=len(size))
    return np.unique(inverse, return_index=True)[1], inverse


class PieceCache:
    """Ids of pieces seen so far in a worker process. Cleared before it would hold more than ``limit`` pieces or ``most`` characters."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 500_000, most: int = 16_000_000):
        self._encode, self._limit, self._most = encode, limit, most
        self._clear()

    def _clear(self) -> None:
        self._place: dict[str, int] = {}
        self._chars = 0
        self._from = np.zeros(0, np.int64)
        self._size = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        ids, size = self._encode(pieces)
        for piece in pieces:
            self._place[piece] = len(self._place)
        self._from = np.concatenate([self._from, len(self._ids) + np.cumsum(size) - size])
        self._size = np.concatenate([self._size, size])
        self._ids = np.concatenate([self._ids, ids])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids start (one more at the end)."""
        joined, bounds, hashes, first = split(texts)
        where, inverse = different(joined, bounds, hashes)
        pieces = [joined[a:b] for a, b in zip(bounds[where].tolist(), bounds[where + 1].tolist())]
        chars = int((bounds[where + 1] - bounds[where]).sum())
        if len(self._place) + len(pieces) > self._limit or self._chars + chars > self._most:
            self._clear()
        new = [piece for piece in pieces if piece not in self._place]
        if new:
            self._chars += sum(map(len, new))
            self._learn(new)
        at = np.fromiter(map(self._place.__getitem__, pieces), dtype=np.int64, count=len(pieces))[inverse]
        size, start = self._size[at], self._from[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._ids[np.repeat(start - (ends - size), size) + np.arange(total)] if total else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], ends])[first]
