"""Removal of long repeated passages (operator 13) by recompression.

The words of a text are symbols. A round names every run of equal symbols and then every pair of neighbours of which the
first is on the left and the second on the right by a bit of their names; such a pair or run becomes one symbol. A name is a
128-bit function of the names it stands for (of a cryptographic digest for a word), so all tasks name alike and equal
stretches of words get the same symbols inside, without the texts being moved. What decides on a symbol reaches a little to
its left and right: the words from ``low`` to ``high``. Wherever those words stand, the symbol stands too.

1. Texts are laid out in blocks of about four million characters, each a dictionary of words and their numbers; staged.
2. A Spark round counts the names of small symbols (after ``ROUNDS`` rounds) and of symbols of at least a window. A window that
   holds ``low`` to ``high`` of a small symbol found once in the corpus is found once itself. A long symbol found again repeats
   every window in it: its words go.
3. A second Spark round counts the windows that are left, those over borders of repeated symbols, by their words, together
   with the windows of one place of every repeated long symbol.

Each block names a symbol or window once however often it holds it, so a name that every text has is at most one row for each
block, and what comes back to a block is bounded by the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.hashing import mix
from tidemark.session import stage

#: Words of a window.
WINDOW = 35
#: Rounds after which symbols are small enough that a window holds whole ones with what decides on them (5.6 words on average).
ROUNDS = 6
#: Rounds after which long symbols are named first, and from there on every so many rounds.
LONG, STEP = 12, 3
#: Characters of the texts of a block; a longer text is a block of its own.
BLOCK = 4_000_000
_MOST_ROUNDS = 60
_FAR = 1 << 29
_LANES = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F]], dtype=np.uint64)
_PAIR, _RUN, _SPAN = (np.array([[a], [b]], dtype=np.uint64) for a, b in (
    (0x165667B19E3779F9, 0x27D4EB2F165667C5), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F), (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)))

BLOCKS = "block long, doc_ids array<long>, sizes array<int>, vocabulary binary, codes binary"
JUDGED = BLOCKS + ", sure binary, open binary"
NAMES = "a long, b long, block long, slot int"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _joined(x: np.ndarray, y: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Names (two lanes) of what stands for ``x`` followed by ``y``."""
    with np.errstate(over="ignore"):
        return mix(x * _LANES + mix(y + kind))


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Block:
    """The words of some texts: ``codes`` numbers them, ``words`` lists the different ones, ``first`` says where texts start."""

    def __init__(self, sizes: np.ndarray, words: list[bytes], codes: np.ndarray):
        self.words, self.codes = words, codes
        self.first = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=self.first[1:])

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        numbers, sizes, codes = _Numbers(), [], []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space
            sizes.append(len(words))
            codes.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
        return cls(np.array(sizes, dtype=np.int64), list(numbers), np.concatenate(codes) if codes else np.zeros(0, np.int32))

    def packed(self) -> tuple[bytes, bytes]:
        narrow = self.codes.astype(np.uint16 if len(self.words) <= 1 << 16 else np.uint32)
        return tuple(len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in (b"\n".join(self.words), narrow.tobytes()))

    @classmethod
    def unpacked(cls, sizes: list[int], vocabulary: bytes, codes: bytes) -> Block:
        listed, raw = (pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x in (vocabulary, codes))
        words = listed.split(b"\n") if sum(sizes) else []
        kind = np.dtype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
        return cls(np.array(sizes, dtype=np.int64), words, np.frombuffer(raw, dtype=kind).astype(np.int32))

    def names(self) -> np.ndarray:
        """The name of every word, two lanes."""
        digests = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in self.words)
        return np.ascontiguousarray(np.frombuffer(digests, dtype="<u8").reshape(-1, 2).T)[:, self.codes]

    def room(self) -> np.ndarray:
        """Words from every word to the end of its text."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.codes))


class Symbols:
    """The symbols of a block after some rounds: names, places (``start`` to ``end``), what decides on them (``low`` to ``high``, up to ``ROUNDS``)."""

    def __init__(self, block: Block):
        self.codes = block.codes
        self.name = block.names()
        self.start = np.arange(len(block.codes), dtype=np.int32)
        self.end = self.start + np.int32(1)
        self.low, self.high = self.start.copy(), self.end.copy()
        self.opens = np.zeros(len(block.codes), dtype=bool)  # first symbol of a text
        self.opens[block.first[:-1][np.diff(block.first) > 0]] = True
        self.born = np.zeros(len(block.codes), dtype=np.int8)  # the round that made the symbol
        self.rounds = 0

    def _keep(self, at: np.ndarray) -> None:
        for part in ("start", "end", "low", "high", "opens", "born"):
            setattr(self, part, getattr(self, part)[at])
        self.name = np.stack([lane[at] for lane in self.name])

    def _runs(self) -> None:
        equal = np.zeros(len(self.start), dtype=bool)
        equal[1:] = (self.name[0, 1:] == self.name[0, :-1]) & (self.name[1, 1:] == self.name[1, :-1]) & ~self.opens[1:]
        if equal.any():
            head = np.flatnonzero(~equal)
            size = np.diff(np.append(head, len(equal)))
            last_end = self.end[head + size - 1]
            low, high = np.minimum.reduceat(self.low, head), np.maximum.reduceat(self.high, head)
            self._keep(head)
            self.end, self.low, self.high = last_end, low, high
            many = np.flatnonzero(size > 1)
            self.name[:, many] = _joined(self.name[:, many], size[many].astype(np.uint64)[None, :], _RUN)
            self.born[many] = self.rounds
        if self.rounds > ROUNDS:
            return  # what decides on longer symbols is not asked for
        # A run ends where another symbol follows: one word more tells, unless it is the word at the symbol's other end.
        closes = np.append(self.opens[1:], True)
        before, after = self.codes[np.maximum(self.start - 1, 0)], self.codes[np.minimum(self.end, len(self.codes) - 1)]
        unsure_left = ~self.opens & (before == self.codes[self.end - 1])
        unsure_right = ~closes & (after == self.codes[self.start])
        low = np.where(self.opens, -_FAR, np.minimum(self.low, self.start - 1))
        high = np.where(closes, _FAR, np.maximum(self.high, self.end + 1))
        for unsure, step in ((unsure_left, -1), (unsure_right, 1)):
            at = np.flatnonzero(unsure)
            low[at] = np.minimum(low[at], self.low[at + step])
            high[at] = np.maximum(high[at], self.high[at + step])
        self.low, self.high = low, high

    def _pairs(self) -> None:
        right = (self.name[0] >> np.uint64(self.rounds)) & np.uint64(1) == 1
        pair = np.zeros(len(right), dtype=bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~self.opens[1:]
        second = np.zeros(len(right), dtype=bool)
        second[1:] = pair[:-1]
        at = np.flatnonzero(pair)
        if self.rounds <= ROUNDS:
            alone = ~pair & ~second
            closes = np.append(self.opens[1:], True)
            low, high = self.low.copy(), self.high.copy()
            for side, edge, step in ((alone & ~right, closes, 1), (alone & right, self.opens, -1)):  # alone because of that neighbour
                by = np.flatnonzero(side & ~edge)
                low[by], high[by] = np.minimum(low[by], self.low[by + step]), np.maximum(high[by], self.high[by + step])
            high[alone & ~right & closes] = _FAR
            low[alone & right & self.opens] = -_FAR
            low[at], high[at] = np.minimum(self.low[at], self.low[at + 1]), np.maximum(self.high[at], self.high[at + 1])
            self.low, self.high = low, high
        self.end[at] = self.end[at + 1]
        self.name[:, at] = _joined(self.name[:, at], self.name[:, at + 1], _PAIR)
        self.born[at] = self.rounds
        self._keep(np.flatnonzero(~second))

    def round(self) -> None:
        self.rounds += 1
        self._runs()
        self._pairs()


def _ranges(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges (ends exclusive)."""
    some = start < end
    change = np.bincount(start[some], minlength=n + 1) - np.bincount(end[some], minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def _different(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of one of each different (a, b), the number of each place's among them, and how often each stands."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse, np.diff(np.append(np.flatnonzero(new), len(order)))


class Parsed:
    """Small symbols that windows can hold, and long symbols, of a block; numbered by their different names."""

    def __init__(self, block: Block):
        symbols = Symbols(block)
        texts = int((np.diff(block.first) > 0).sum())
        names, starts, ends, named = [], [], [], 0
        small = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        while symbols.rounds < _MOST_ROUNDS and len(block.codes):
            symbols.round()
            if symbols.rounds == ROUNDS:
                held = np.flatnonzero(symbols.high - symbols.low <= WINDOW)
                small = symbols.name[0, held], symbols.low[held], symbols.high[held]
            over = symbols.rounds >= ROUNDS and len(symbols.start) == texts
            if over or (symbols.rounds >= LONG and (symbols.rounds - LONG) % STEP == 0):
                at = np.flatnonzero((symbols.end - symbols.start >= WINDOW) & (symbols.born > named))
                names.append(symbols.name[:, at])
                starts.append(symbols.start[at])
                ends.append(symbols.end[at])
                named = symbols.rounds
            if over:
                break
        name, self.low, self.high = small
        long = np.concatenate(names, axis=1) if names else np.zeros((2, 0), np.uint64)
        none = np.zeros(0, np.int64)
        self.start, self.end = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        here, self.small_number, times = _different(name, np.zeros_like(name))
        there, number, more = _different(long[0], long[1])
        self.long_number = number + len(here)
        self.a, self.b = np.concatenate([name[here], long[0, there]]), np.concatenate([np.zeros(len(here), np.uint64), long[1, there]])
        self.times = np.concatenate([times, more])


def window_names(block: Block, at: np.ndarray) -> np.ndarray:
    """Names of the windows that start at some places, from their words by doubling."""
    if not len(at):
        return np.zeros((2, 0), np.uint64)
    level, width, out, done = block.names(), 1, None, 0
    while True:
        if WINDOW & width:
            part = level[:, at + done]
            out, done = part if out is None else _joined(out, part, _SPAN), done + width
        if 2 * width > WINDOW:
            return out
        level, width = _joined(level[:, :-width], level[:, width:], _SPAN), 2 * width


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def blocks_of(docs: DataFrame, limit: int = BLOCK) -> DataFrame:
    """Texts as blocks (``BLOCKS``), staged: nothing is shuffled, and later passes read the same blocks."""
    schema = _arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def done() -> pa.RecordBatch:
            block = Block.of(texts)
            return _batch([[number], [ids], [np.diff(block.first).tolist()], *([x] for x in block.packed())], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n = len(text) if text else 0
                if ids and size + n > limit:
                    yield done()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += n
        if ids:
            yield done()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return stage(rows.mapInArrow(run, BLOCKS), "word-blocks")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row, Block.unpacked(row["sizes"], row["vocabulary"], row["codes"])


def _naming(number: int, a: np.ndarray, b: np.ndarray, times: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    slot = 2 * np.arange(len(a), dtype=np.int32) + (times > 1)
    return _batch([a.view(np.int64), b.view(np.int64), np.full(len(a), number), slot.astype(np.int32)], schema)


def found_again(names: DataFrame) -> DataFrame:
    """Of each block, the numbers of its names that stand elsewhere too, in the block itself or in another one.

    Numbers come doubled, plus one in the block that leads: the first one that has the name.
    """
    same = Window.partitionBy("a", "b")
    again = names.withColumns({"blocks": F.count(F.lit(1)).over(same), "first": F.min("block").over(same)}).where(
        (F.col("blocks") > 1) | (F.col("slot") % 2 == 1))
    number = F.shiftright("slot", 1) * 2 + (F.col("block") == F.col("first")).cast("int")
    return again.groupBy("block").agg(F.collect_list(number).alias("again"))


def _flags(again: list[int] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` names stand elsewhere too, and of which the block leads."""
    out, leads = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if again:
        numbers = np.array(again)
        out[numbers >> 1] = True
        leads[numbers[numbers & 1 == 1] >> 1] = True
    return out, leads


def judge(block: Block, p: Parsed, again: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that surely go, and starts of windows that are still open, given which names stand elsewhere too.

    Windows in a repeated long symbol need not be asked for, but others like them may have to hear of them: the block that
    leads the symbol names them.
    """
    n = len(block.codes)
    once = ~again[p.small_number]
    known = _ranges(np.maximum(p.high[once] - WINDOW, 0), p.low[once] + 1, n)
    long, lead = again[p.long_number], leads[p.long_number]
    sure = _ranges(p.start[long], p.end[long], n)
    told, telling = (_ranges(p.start[x], p.end[x] - WINDOW + 1, n) for x in (long & ~lead, lead))
    return sure, (block.room() >= WINDOW) & ~known & (~told | telling)


def judged(blocks: DataFrame) -> DataFrame:
    """First Spark round: which words surely go, and which windows are still open, as bits (``JUDGED``), staged."""
    name_schema, schema = _arrow(NAMES), _arrow(JUDGED)

    def naming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _rows(batches):
            p = Parsed(block)
            yield _naming(row["block"], p.a, p.b, p.times, name_schema)

    def judging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _rows(batches):
            p = Parsed(block)
            sure, open_ = judge(block, p, *_flags(row["again"], len(p.a)))
            kept = [[row[f]] for f in schema.names[:5]]
            yield _batch([*kept, [np.packbits(sure).tobytes()], [np.packbits(open_).tobytes()]], schema)

    again = found_again(blocks.mapInArrow(naming, NAMES))
    return stage(blocks.join(again, "block", "left").mapInArrow(judging, JUDGED), "judged-blocks")


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def remove_repeats(docs: DataFrame, limit: int = BLOCK) -> DataFrame:
    """Number of words, of words removed, and digest of the words kept, of every document (``RESULT``).

    A word goes if it lies in a window of 35 words whose sequence of words starts anywhere else too, in its own document
    or another. Windows are judged on the input. Null and empty texts have no words; texts of fewer words than a window keep
    all; rows that share an id or a text are judged and returned one by one; so are rows without an id.
    """
    name_schema, schema = _arrow(NAMES), _arrow(RESULT)

    def open_windows(row: dict, block: Block) -> tuple[np.ndarray, np.ndarray, tuple]:
        at = np.flatnonzero(_bits(row["open"], len(block.codes)))
        names = window_names(block, at)
        return at, names, _different(names[0], names[1])

    def naming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _rows(batches):
            _, names, (one, _, times) = open_windows(row, block)
            yield _naming(row["block"], names[0, one], names[1, one], times, name_schema)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _rows(batches):
            at, _, (one, number, _) = open_windows(row, block)
            n = len(block.codes)
            start = at[_flags(row["again"], len(one))[0][number]]
            keep = ~(_bits(row["sure"], n) | _ranges(start, start + WINDOW, n))
            rows = []
            for doc_id, a, b in zip(row["doc_ids"], block.first[:-1].tolist(), block.first[1:].tolist()):
                codes = block.codes[a:b][keep[a:b]].tolist()
                kept = b" ".join(map(block.words.__getitem__, codes))
                rows.append((doc_id, b - a, b - a - len(codes), hashlib.sha256(kept).hexdigest()))
            yield _batch(list(zip(*rows)), schema)

    blocks = judged(blocks_of(docs, limit))
    again = found_again(blocks.mapInArrow(naming, NAMES))
    return blocks.join(again, "block", "left").mapInArrow(result, RESULT)


ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT r, p, sha256(array_to_string(w[p:p + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM texts WHERE len(w) >= 35)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p + k AS i FROM windows SEMI JOIN again USING (h), range(35) AS s(k)),
lists AS (SELECT r, list(i) AS gone FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '') END) AS kept_sha256
FROM texts LEFT JOIN lists USING (r)
"""
