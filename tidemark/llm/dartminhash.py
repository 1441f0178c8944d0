"""Near-duplicate documents by DartMinHash (operator 2).

Think of each element as a strip as high as its weight along an axis of ranks. A hash of the element throws darts at the strip, a
fixed number on average for each unit of area, every dart belonging to one of the coordinates of the signature. The
earliest dart of a coordinate over all elements of a set is its value. Two sets agree in a coordinate with a probability
equal to their weighted Jaccard similarity. Only darts up to the rank at which all coordinates are likely to be
filled need be thrown, about ``t ln t`` for a signature of ``t`` however many elements there are; a set with an empty
coordinate is thrown at again with twice the reach. Strips are cut at powers of two, so heavy elements take few pieces.

Signatures are cut into bands; texts that agree in a band are candidates, and exact similarity decides (``links``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import links
from tidemark.llm.common import fresh, map_texts, shuffled
from tidemark.llm.hashing import chunks, mix, shingles, uniform
from tidemark.session import stage

#: Bands and rows in a band: a pair of similarity 0.8 meets with probability 1 - (1 - 0.8 ** 5) ** 30 = 0.999993.
BANDS, ROWS = 30, 5
_REACH = 4.0
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & (1 << 64) - 1) for j in range(64)]


def signatures(elements: np.ndarray, first: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    """One row of ``size`` values for each set; set ``i`` has the elements from ``first[i]`` to ``first[i + 1]``.

    Without weights an element counts once, however often it is listed. Listed weights must belong to different elements of a
    set. An empty set, or one whose weights are all 0, has a row of zeros.
    """
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    weight = np.ones(len(elements)) if weights is None else np.asarray(weights, dtype=np.float64)
    total = np.bincount(owner, weight, n)
    out = np.zeros((n, size), dtype=np.uint64)
    pending = np.flatnonzero(total > 0)
    reach = np.zeros(n)
    reach[pending] = (np.log(size) + _REACH) / total[pending]
    while len(pending):
        row = np.full(n, -1)
        row[pending] = np.arange(len(pending))
        use = np.flatnonzero((row[owner] >= 0) & (weight > 0))
        place, rank, dart = _throw(elements[use], weight[use], row[owner[use]], reach[owner[use]], size)
        best = np.full(len(pending) * size, np.inf)
        np.minimum.at(best, place, rank)
        won = rank == best[place]
        value = np.zeros(len(best), dtype=np.uint64)
        value[place[won]] = dart[won]
        done = np.isfinite(best).reshape(-1, size).all(axis=1)
        out[pending[done]] = value.reshape(-1, size)[done]
        pending = pending[~done]
        reach[pending] *= 2
    return out


def _throw(elements: np.ndarray, weight: np.ndarray, row: np.ndarray, reach: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts within reach: place (row and coordinate), rank, and the dart itself."""
    places, ranks, darts = [], [], []
    low, high, strip = 0.0, 1.0, 0
    while strip == 0 or (weight > low).any():
        at = np.flatnonzero(weight > low)
        area = high - low
        key = mix(elements[at] + _ODD[strip % 64])
        rank = np.zeros(len(at))
        turn = 0
        while len(at):
            dart = mix(key + np.uint64(turn * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            rank = rank - np.log(uniform(dart)) / (size * area)
            near = rank <= reach[at]
            at, key, rank, dart = at[near], key[near], rank[near], mix(dart[near] + np.uint64(1))
            hit = low + uniform(mix(dart)) * area <= weight[at]
            places.append(row[at[hit]] * size + (dart[hit] % np.uint64(size)).astype(np.int64))
            ranks.append(rank[hit])
            darts.append(dart[hit])
            turn += 1
        low, high, strip = high, high * 2, strip + 1
    return np.concatenate(places), np.concatenate(ranks), np.concatenate(darts)


def bands(values: np.ndarray, count: int, rows: int) -> np.ndarray:
    """One number for each band of each signature."""
    cut = values[:, : count * rows].reshape(len(values), count, rows)
    out = np.zeros((len(values), count), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out += mix(cut[:, :, j] + _ODD[j])  * _ODD[j + 1]
    return mix(out).view(np.int64)


def text_bands(texts: Sequence[str | None], count: int = BANDS, rows: int = ROWS) -> list[np.ndarray | None]:
    """Bands of the set of five-word shingles of each text; None for a text without words."""
    out: list[np.ndarray | None] = []
    for a, b in chunks(texts):
        elements, first = shingles(texts[a:b])
        found = bands(signatures(elements, first, count * rows), count, rows)
        out += [x if n else None for x, n in zip(found, np.diff(first).tolist())]
    return out


def classified(docs: DataFrame, signer=text_bands, least: float = links.SIMILAR) -> DataFrame:
    """``doc_id, key, class_key, class_id`` of every row, the keys standing for texts; see ``near_duplicates``."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("key", links.text_key(F.col("text")))
    signed = stage(map_texts(rows, lambda texts, batch: {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "bands": signer(texts)},
                             "doc_id long, key binary, bands array<long>"), "signed")
    # Copies fold here, before anything is compared; the partial aggregate keeps a large group of copies out of the shuffle.
    different = stage(signed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "different")
    chosen = different.select(F.col("key").alias("own_key"), F.col("doc_id").alias("own_id"))
    texts = rows.where(F.col("key").isNotNull()).join(shuffled(chosen), (F.col("key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("key", "text")
    classes = links.group(different.select("key", "bands"), texts, least)
    classed = different.select("key", "doc_id").join(shuffled(classes), different["key"] == classes["node"], "left").select(
        "key", "doc_id", F.coalesce("class", "key").alias("class"))
    names = classed.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    named = classed.join(shuffled(names), "class").select(F.col("key").alias("own_key"), F.col("class").alias("class_key"), "class_id")
    return signed.select("doc_id", "key").join(shuffled(named), F.col("key") == F.col("own_key"), "left").select(
        "doc_id", "key", "class_key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def near_duplicates(docs: DataFrame, signer=text_bands, least: float = links.SIMILAR) -> DataFrame:
    """``doc_id, class_id`` of every row: near duplicates share a class, named by its smallest document id.

    Two documents are linked if their texts are equal or the sets of their five-word shingles have a Jaccard similarity of
    ``least`` or more; a text of one to four words has one shingle. Classes are the connected documents. Texts without a
    word, null ones too, are classes of their own. Rows that repeat an id stay rows; a class without any id has a null name.
    Columns other than ``doc_id`` and ``text`` are not read.
    """
    return classified(docs, signer, least).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest id, with its own columns; texts without a word all stay.

    Of rows that repeat the id and text of a kept document one stays. In a class without any id, one text stays.
    """
    key, turn, own = fresh("dedup_key", docs), fresh("dedup_turn", docs), fresh("dedup_id", docs)
    classed = stage(classified(docs), "classes").where(F.col("key").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    winner = classed.groupBy("class_key").agg(first).select(F.col("first.doc_id").alias(own), F.col("first.key").alias(key))
    keyed = docs.withColumn(key, links.text_key(F.col("text").cast("string")))
    met = keyed.join(shuffled(winner.withColumnRenamed(key, key + "_")), (F.col(key) == F.col(key + "_")) & F.col("doc_id").cast("long").eqNullSafe(F.col(own)))
    once = met.withColumn(turn, F.row_number().over(Window.partitionBy(key + "_", own).orderBy(F.lit(1)))).where(F.col(turn) == 1)
    return once.select(*docs.columns).unionByName(keyed.where(F.col(key).isNull()).select(*docs.columns))
