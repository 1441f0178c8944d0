"""Document fingerprints (operator 7): MinHash over five-word shingles.

A fingerprint has one value for each of a number of universal hash functions ``a x + b`` (modulo 2**64, upper half): its smallest
value over the shingles of the text, computed for all texts of a batch in numpy. The share of equal values estimates the
Jaccard similarity of two texts. ``near_duplicates`` joins bands of fingerprints in Spark and verifies similarities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm import dartminhash, links
from tidemark.llm.common import fresh, map_texts
from tidemark.llm.hashing import chunks, shingles

#: Hash functions of a fingerprint.
SIZE = 64
#: Bands of a longer signature that find candidates at a similarity of 0.8: 40 of 5 values each.
BANDS, ROWS = 40, 5
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _functions(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    draw = lambda: rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def minhash(elements: np.ndarray, first: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Smallest value of each hash function over each set, 32 bits; an empty set has the largest value everywhere."""
    counts = np.diff(first)
    some = np.flatnonzero(counts > 0)
    out = np.full((len(counts), size), 0xFFFFFFFF, dtype=np.uint32)
    if len(some):
        x = elements >> np.uint64(32)
        starts = first[:-1][some]
        factor, term = _functions(size)
        with np.errstate(over="ignore"):
            for i in range(size):
                out[some, i] = np.minimum.reduceat(x * factor[i] + term[i], starts) >> np.uint64(32)
    return out


def fingerprint(texts: Sequence[str | None], size: int = SIZE) -> np.ndarray:
    """One row for each text."""
    parts = [minhash(*shingles(texts[a:b]), size) for a, b in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, size), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values, row by row."""
    return (a == b).mean(axis=1)


def text_bands(texts: Sequence[str | None]) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for a, b in chunks(texts):
        elements, first = shingles(texts[a:b])
        cut = dartminhash.bands(minhash(elements, first, BANDS * ROWS).astype(np.uint64), BANDS, ROWS)
        out += [x if n else None for x, n in zip(cut, np.diff(first).tolist())]
    return out


def near_duplicates(docs: DataFrame, least: float = links.SIMILAR) -> DataFrame:
    """``doc_id, class_id`` of every row: bands of MinHash signatures are joined and similarities verified; rules as in ``dartminhash``."""
    return dartminhash.near_duplicates(docs, text_bands, least)


def _dealt(docs: DataFrame) -> DataFrame:
    """The texts in ascending order of their ids, in ranges, one range to a partition; behind each range the text that follows it.

    Range borders are quantiles of the ids. The first document of a range goes to the range before as a guest too, the very
    first one to the last range: one row more for each range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    cuts = rows.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    borders = np.unique(np.array(cuts, dtype=np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, ids.to_numpy(), side="right").astype(np.int32))

    known = F.coalesce("doc_id", F.lit(-(1 << 63)))  # rows without an id come first; whole numbers stay whole numbers
    own = rows.select("doc_id").withColumn("part", range_of(known))
    heads = own.groupBy("part").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("unnamed")).orderBy("part").collect()
    used = [h["part"] for h in heads]
    before = [(used[i - 1], None if h["unnamed"] else h["low"]) for i, h in enumerate(heads)]  # one row for each range
    guests = spark.createDataFrame(before, "part int, first_id long")
    placed = rows.withColumn("part", range_of(known)).withColumn("guest", F.lit(False))
    visiting = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("first_id"))).select(
        "doc_id", "text", "part", F.lit(True).alias("guest"))
    return (placed.unionByName(visiting).withColumn("text_hash", F.xxhash64("text")).repartitionById(parts, F.col("part"))
            .sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text_hash"))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every whole text and of its edited text (``SCHEMA``), and how like it is to that and to the next document.

    The next document is the one with the next larger id; rows that share an id stand in the order of a hash of their texts, rows without
    an id come first, and the first follows the last. A null text is empty. Texts without a word have one and the same
    fingerprint, so they are wholly like each other. One shuffle moves each text once; a task holds a batch of texts.
    """
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def described(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        changed = [edited(a, b) for a, b in zip(texts, [*texts[1:], following])]
        own, new = fingerprint([*texts, following]), fingerprint(changed)
        columns = ([r[0] for r in rows], [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                   [x.tobytes().hex() for x in own[:-1]], [x.tobytes().hex() for x in new],
                   likeness(own[:-1], new), likeness(own[:-1], own[1:]))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int | None, str]] = []
        size = 0
        for batch in batches:
            for doc_id, text, guest in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "guest"))):
                if rows and (guest or size > 1_000_000):  # a guest ends its range
                    yield described(rows, text)
                    rows, size = [], 0
                if not guest:
                    rows.append((doc_id, text))
                    size += len(text)
        if rows:
            raise ValueError("a range of documents without the one that follows")

    return _dealt(docs).select("doc_id", "text", "guest").mapInArrow(run, SCHEMA)
