"""Byte-level BPE encoding and decoding (operator 5).

Each match of the pre-tokenization pattern is encoded by itself. A segment tree over its byte positions stores the leftmost
smallest rank of a pair of live neighbours; a merge takes the root, joins the two tokens and updates three leaves and their
ancestors. Matches of like length share one array of trees, so a batch advances all its matches by one merge at a time;
long matches use one tree each. Equal matches are encoded once per worker.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts
from tidemark.llm.hashing import chunks
from tidemark.llm.pieces import PieceCache

_NONE = np.int64(1) << 60
_WIDEST = 128
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Ranks of byte strings, read from a file of base64 tokens with their ranks; the rank is the id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(self.rank.values()) + 1
        tokens = [b""] * size
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.tokens = tokens
        self._length = np.array([len(t) for t in tokens], dtype=np.int64)
        self._offset = np.cumsum(self._length) - self._length
        self._bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                left, right = self.rank.get(token[:i]), self.rank.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pair = pairs
        self._pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self._pair_rank = np.array([pairs[k] for k in self._pair_keys.tolist()], dtype=np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == key, self._pair_rank[at], _NONE)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the end of each id's bytes."""
        size = self._length[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self._bytes[np.repeat(self._offset[ids] - (ends - size), size) + np.arange(total)], ends


def merge_one(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one byte string by its own segment tree."""
    n = len(piece)
    if n < 2:
        return [int(vocabulary.of_byte[b]) for b in piece]
    width = 1 << (n - 1).bit_length()
    none, pair = int(_NONE), vocabulary.pair
    token = [int(vocabulary.of_byte[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * width)

    def key(i: int) -> int:
        rank = pair.get(token[i] << 20 | token[after[i]]) if after[i] < n else None
        return none if rank is None else rank * width + i

    for i in range(n - 1):
        tree[width + i] = key(i)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        while node > 1:
            node >>= 1
            best = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best

    while tree[1] < none:
        rank, i = divmod(tree[1], width)
        gone = after[i]
        token[i], after[i] = rank, after[gone]
        if after[i] < n:
            before[after[i]] = i
        update(gone, none)
        update(i, key(i))
        if before[i] >= 0:
            update(before[i], key(before[i]))
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = after[i]
    return out


def merge_many(vocabulary: Vocabulary, grid: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token grid and mask of live positions for many byte strings, the rows of ``grid``, whose width is a power of two."""
    rows, width = grid.shape
    column = np.arange(width)
    token = np.zeros((rows, width + 1), dtype=np.int64)
    token[:, :width] = vocabulary.of_byte[grid]
    after = np.broadcast_to(column + 1, (rows, width)).copy()
    before = np.broadcast_to(column - 1, (rows, width + 1)[:1] + (width,)).copy()
    tree = np.full((rows, 2 * width), _NONE, dtype=np.int64)
    both = column[None, 1:] < length[:, None]
    rank = vocabulary.pair_rank(token[:, : width - 1], token[:, 1:width])
    tree[:, width : 2 * width - 1] = np.where(both & (rank < _NONE), rank * width + column[:-1], _NONE)
    level = width // 2
    while level:
        np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        level //= 2
    live = column < length[:, None]
    rows_left = np.flatnonzero(tree[:, 1] < _NONE)

    def key(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = after[r, i]
        found = vocabulary.pair_rank(token[r, i], token[r, j])
        return np.where((j < length[r]) & (found < _NONE), found * width + i, _NONE)

    while len(rows_left):
        r = rows_left
        new, i = np.divmod(tree[r, 1], width)
        gone = after[r, i]
        follows = after[r, gone]
        token[r, i], after[r, i] = new, follows
        live[r, gone] = False
        inside = follows < length[r]
        before[r[inside], follows[inside]] = i[inside]
        tree[r, width + gone] = _NONE
        tree[r, width + i] = key(r, i)
        j = before[r, i]
        left = j >= 0
        rl, jl = r[left], j[left]
        tree[rl, width + jl] = key(rl, jl)
        nodes = [(r, width + gone), (r, width + i), (rl, width + jl)]
        for _ in range(width.bit_length() - 1):
            nodes = [(a, node >> 1) for a, node in nodes]
            for a, node in nodes:
                tree[a, node] = np.minimum(tree[a, 2 * node], tree[a, 2 * node + 1])
        rows_left = r[tree[r, 1] < _NONE]
    return token[:, :width], live


def encode_pieces(vocabulary: Vocabulary, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, and the number of ids of each. A piece that is a token is that token."""
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    whole = np.array([vocabulary.rank.get(p, -1) for p in raw], dtype=np.int64)
    length = np.array([len(p) for p in raw], dtype=np.int64)
    size = np.where(whole >= 0, 1, 0)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # (piece numbers, their ids one after the other)
    done = np.flatnonzero(whole >= 0)
    parts.append((done, whole[done]))
    low = 1
    while low < _WIDEST:
        width = 2 * low
        chosen = np.flatnonzero((whole < 0) & (length > low) & (length <= width))
        if len(chosen):
            flat = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in chosen.tolist()), dtype=np.uint8)
            token, live = merge_many(vocabulary, flat.reshape(len(chosen), width), length[chosen])
            size[chosen] = live.sum(axis=1)
            parts.append((chosen, token[live]))
        low = width
    for i in np.flatnonzero((whole < 0) & (length > _WIDEST)).tolist():
        ids = merge_one(vocabulary, raw[i])
        size[i] = len(ids)
        parts.append((np.array([i]), np.array(ids, dtype=np.int64)))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint32)
    for chosen, ids in parts:
        n = size[chosen]
        ends = np.cumsum(n)
        out[np.repeat(start[chosen] - (ends - n), n) + np.arange(len(ids))] = ids
    return out, size


_tools: dict[str, tuple[Vocabulary, PieceCache]] = {}


def codec(path: str) -> tuple[Vocabulary, PieceCache]:
    """Vocabulary and piece cache of this process."""
    if path not in _tools:
        vocabulary = Vocabulary(path)
        _tools[path] = vocabulary, PieceCache(lambda pieces: encode_pieces(vocabulary, pieces))
    return _tools[path]


def encode(path: str, texts: Sequence[str | None]) -> list[np.ndarray]:
    """Ids of each text."""
    _, cache = codec(path)
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        ids, first = cache.encode([t or "" for t in texts[a:b]])
        out += [ids[first[i] : first[i + 1]] for i in range(b - a)]
    return out


def decode(path: str, ids: np.ndarray) -> bytes:
    return codec(path)[0].decode(np.asarray(ids, dtype=np.int64))[0].tobytes()


def tokenize(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text: ``SCHEMA``, with the ids themselves if ``keep_ids``.

    A null text counts as empty: no ids, the check sums of nothing. Rows are kept one to one, repeated ones and those
    without an id too; columns other than ``doc_id`` and ``text`` are not read. A lone surrogate cannot occur in a column.
    """

    def run(texts, batch):
        out = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for a, b in chunks(texts):
            vocabulary, cache = codec(path)
            ids, first = cache.encode([t or "" for t in texts[a:b]])
            data, ends = vocabulary.decode(ids)
            ends = np.concatenate([[0], ends])[first]
            wide = ids.astype("<u4")
            for i in range(b - a):
                out["n_tokens"].append(int(first[i + 1] - first[i]))
                out["ids_sha256"].append(hashlib.sha256(wide[first[i] : first[i + 1]]).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(data[ends[i] : ends[i + 1]]).hexdigest())
                if keep_ids:
                    out["ids"].append(ids[first[i] : first[i + 1]].astype(np.int32))
        return out

    return map_texts(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run,
                     SCHEMA + (", ids array<int>" if keep_ids else ""))
