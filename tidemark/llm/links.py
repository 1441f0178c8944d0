"""Near-duplicate classes from banded signatures, without emitting the pairs of a bucket.

Texts that share a band stand in one bucket. Every member of a bucket is compared with its leader, the member that shares most
with others; near ones join the leader's class. What can still be missing are links between members of one leader that
are not of one class. Let A be the shingles of a text, C those of its leader and R their symmetric difference. The difference
of two members is the difference of their R, and a member far from the leader has a large R, so near members must share more
than four ninths of the smaller R. That is searched exactly, by an inverted index over a prefix of R, the shingles that
the leader lacks first: those are rare, so a bucket of thousands of near copies gives few candidates. Leaders with a
few members have all open pairs compared. All similarities are exact, from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import shuffled
from tidemark.llm.hashing import chunks, shingles
from tidemark.session import stage

#: Similarity of the sets of five-word shingles from which two texts are near duplicates.
SIMILAR = 0.8
#: Leaders with so many members at most have their open pairs compared without the index.
_FEW = 8


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null for a text without a word."""
    return F.when(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.unhex(F.md5(text)))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (``a, b`` and others) with both texts."""
    own = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    other = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(shuffled(own), "b").join(shuffled(other), "a")


def _sets(batch: pa.RecordBatch) -> dict[bytes, np.ndarray]:
    """Sorted shingles of every text of a batch, by key."""
    text = dict(zip(batch.column("a").to_pylist(), batch.column("text_a").to_pylist())) | dict(
        zip(batch.column("b").to_pylist(), batch.column("text_b").to_pylist()))
    keys, sets = list(text), {}
    for low, high in chunks(list(text.values())):
        own, first = shingles([text[k] for k in keys[low:high]])
        sets |= {k: np.unique(own[first[i] : first[i + 1]]) for i, k in enumerate(keys[low:high])}
    return sets


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, size_a, size_b, apart``: numbers of shingles of two texts, and of shingles that only one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, found = _sets(batch), []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                found.append((len(sets[x]), len(sets[y]), len(sets[x]) + len(sets[y]) - 2 * common))
            numbers = np.array(found, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *map(pa.array, numbers.T)], ["a", "b", "size_a", "size_b", "apart"])

    return _with_texts(pairs.select("a", "b"), texts).mapInArrow(run, "a binary, b binary, size_a long, size_b long, apart long")


def _allowed(sizes: Column, least: float) -> Column:
    """Largest symmetric difference of two sets of together so many elements whose similarity is ``least``."""
    return sizes * ((1 - least) / (1 + least)) + 1e-9


def _close(pairs: DataFrame, least: float) -> DataFrame:
    return pairs.where(F.col("apart") <= _allowed(F.col("size_a") + F.col("size_b"), least)).select("a", "b")


def _differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``leader, key, class, seeks, size, apart, element, place``: the first shingles by which each member differs from its leader.

    Shingles that the leader lacks come first, then the others, both by hash. A member outside the leader's class ``seeks``
    partners. ``most`` is the last place that the first common shingle of a near pair can have: two members that share ``o`` of
    their differences share one among the first ``apart - o + 1`` of each.
    """
    schema = "leader binary, key binary, class binary, seeks boolean, size long, apart long, element long, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            sets = _sets(batch)
            for i, (x, y, own_class, seeks, most) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("a", "b", "class", "seeks", "most")))):
                new, gone = np.setdiff1d(sets[y], sets[x], assume_unique=True), np.setdiff1d(sets[x], sets[y], assume_unique=True)
                both = np.concatenate([new, gone])[: most + 1].view(np.int64)
                n = len(both)
                same = lambda v, t: pa.array([v] * n, t)
                yield pa.RecordBatch.from_arrays([
                    same(x, pa.binary()), same(y, pa.binary()), same(own_class, pa.binary()), same(seeks, pa.bool_()), same(len(sets[y]), pa.int64()),
                    same(len(new) + len(gone), pa.int64()), pa.array(both), pa.array(np.arange(n))], names)

    return _with_texts(pairs, texts).select("a", "b", "class", "seeks", "most", "text_a", "text_b").mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """``node, class`` for every node of the edges ``a, b``; a class is named by its smallest node.

    Alternating stars: each node's larger neighbours, then its smaller ones, are tied to the smallest neighbour, until nothing
    changes. Paths shorten by a constant factor each time. Every step is a table in the shared folder.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(lower), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lower.select("u", F.col("m").alias("v"))).distinct()
        now = stage(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())
        seen = state


def group(signed: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``node, class``: the keys that have a near duplicate and the class of each.

    ``signed`` has one row for each different text, ``key, bands``; ``texts`` gives ``key, text`` of at least those keys.
    """
    rows = signed.select("key", F.posexplode("bands").alias("band", "value")).select("key", F.xxhash64("band", "value").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = stage(rows.join(shuffled(shared), "bucket"), "buckets")
    weight = rows.groupBy("key").agg(F.sum("n").alias("weight"))
    heads = rows.join(shuffled(weight), "key").groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("head")).select("bucket", F.col("head.key").alias("a"))
    pairs = stage(rows.join(shuffled(heads), "bucket").where("key <> a").select("a", F.col("key").alias("b")).distinct(), "leaders")
    wanted = rows.select("key").distinct()
    held = stage(texts.join(shuffled(wanted), "key", "left_semi").dropDuplicates(["key"]), "candidates")
    pairs = stage(measured(pairs, held), "measured")
    classes = components(_close(pairs, least))

    def class_of(key: str, name: str) -> DataFrame:
        return classes.select(F.col("node").alias(key), F.col("class").alias(name))

    known = pairs.join(shuffled(class_of("b", "class")), "b", "left").join(shuffled(class_of("a", "own")), "a", "left").select(
        "a", "b", "size_a", "size_b", "apart", F.coalesce("class", "b").alias("class"), F.coalesce("own", "a").alias("own"))
    leaders = known.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") != F.col("own")).alias("others")).where("others > 0 AND n > 1")
    known = stage(known.join(shuffled(leaders), "a").withColumn("seeks", F.col("class") != F.col("own")), "open")
    if known.isEmpty():
        return classes

    few = known.where(F.col("n") <= _FEW).select("a", "b", "class")
    small = few.join(shuffled(few.select("a", F.col("b").alias("c"), F.col("class").alias("class_c"))), "a").where(
        "b < c AND class <> class_c").select(F.col("b").alias("a"), F.col("c").alias("b"))

    apart, allowed = F.col("apart"), _allowed(F.col("size_a") + F.col("size_b"), least)
    # A partner of a seeking member shares at least (apart - allowed) / 2 with it, and apart * least / (1 + least) of its own.
    most = F.when(F.col("seeks"), (apart + allowed) / 2).otherwise(apart / (1 + least) + 1)
    first = _differences(known.where(F.col("n") > _FEW).withColumn("most", F.floor(most).cast("long")), held)
    first = stage(first, "differences")
    mixed = first.groupBy("leader", "element").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("leader", "element")
    first = first.join(shuffled(mixed), ["leader", "element"])
    other = first.where("seeks").select("leader", "element", *[F.col(c).alias(f"{c}_") for c in ("key", "class", "size", "apart", "place")])
    overlap = (F.col("apart") + F.col("apart_") - _allowed(F.col("size") + F.col("size_"), least)) / 2
    met = first.join(shuffled(other), ["leader", "element"]).where(
        (F.col("class") != F.col("class_")) & (F.col("place") <= F.col("apart") - overlap) & (F.col("place_") <= F.col("apart_") - overlap))
    large = met.select(F.least("key", "key_").alias("a"), F.greatest("key", "key_").alias("b"))
    more = stage(_close(measured(small.unionByName(large).distinct(), held), least), "more-links")
    if more.isEmpty():
        return classes
    return components(more.unionByName(classes.select(F.col("node").alias("a"), F.col("class").alias("b"))))
