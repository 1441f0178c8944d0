"""Nearest neighbours by largest inner product with collision-counting hashing (operator 3).

Largest inner product becomes smallest distance by one more coordinate: a vector gets what it lacks to the largest norm, a
query is brought to that norm and gets 0. Vectors and queries are projected on random directions; in each block of vectors
every direction keeps its projections as one sorted array. A query's windows in these arrays are centred at its own
projections. Virtual rehashing widens them step by step; a vector that has fallen into enough windows is verified by its exact
inner product. A query is done when its k-th best verified distance is within the radius the windows stand for.

Blocks of vectors meet blocks of queries, so a task holds one of each. Within a block nothing is capped: at the widest radius
every vector is verified.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.rows import top_n


@dataclass(frozen=True)
class Settings:
    """``directions`` projections, of which ``share`` must collide; a window reaches ``width`` times the radius to either side."""

    directions: int = 64
    share: float = 0.79
    width: float = 1.35
    growth: float = 1.1
    start: float = 0.9  # first radius, as a share of the usual distance of the k-th neighbour
    block: int = 4096
    query_block: int = 2048
    seed: int = 5

    def __post_init__(self):
        if not 0 < self.directions < 256:  # collisions are counted in bytes
            raise ValueError("between 1 and 255 directions")


class Block:
    """Vectors of one block, in double precision, with the sorted arrays of their projections."""

    def __init__(self, vectors: np.ndarray, largest: float, settings: Settings = Settings()):
        self.vectors, self.largest, self.settings = vectors, largest, settings
        n, d = vectors.shape
        lack = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0))
        self._directions = np.random.default_rng(settings.seed).normal(size=(d + 1, settings.directions))
        places = np.column_stack([vectors, lack]) @ self._directions
        order = np.argsort(places, axis=0, kind="stable").T
        self._sorted = np.take_along_axis(places.T, order, axis=1)
        # Place of each vector in each sorted array; unsigned, so that one comparison tells whether it lies in a window.
        self._place = np.empty(order.shape, dtype=np.uint16 if n <= 1 << 16 else np.uint32)
        np.put_along_axis(self._place, order, np.broadcast_to(np.arange(n, dtype=self._place.dtype), order.shape), axis=1)
        self._enough = int(np.ceil(settings.share * settings.directions))

    def _first_radius(self, queries: np.ndarray, norm: np.ndarray, k: int) -> float:
        """Where widening starts: somewhat below the usual distance of the k-th neighbour, from a few queries; it saves empty rounds."""
        some = np.linspace(0, len(queries) - 1, min(len(queries), 16)).astype(int)
        scores = self.vectors @ queries[some].T / norm[some]
        rank = min(k, len(self.vectors)) - 1
        kth = -np.partition(-scores, rank, axis=0)[rank]
        return self.settings.start * float(np.median(np.sqrt(np.maximum(2 * self.largest**2 - 2 * self.largest * kth, 0)))) + 1e-9 * self.largest

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the best verified rows, ``k`` besides its own and all ties, with their inner products; ``own`` is the query's row in the block, or -1."""
        n, m = len(self.vectors), self.settings.directions
        norm = np.sqrt((queries**2).sum(axis=1))
        centre = (queries * (self.largest / norm)[:, None]) @ self._directions[:-1]
        rows: list[list[np.ndarray]] = [[] for _ in queries]
        scores: list[list[np.ndarray]] = [[] for _ in queries]
        done = np.zeros((len(queries), n), dtype=bool)
        shifted, inside = np.empty_like(self._place), np.empty(self._place.shape, dtype=bool)
        active = np.arange(len(queries))
        radius = self._first_radius(queries, norm, k)
        while len(active):
            reach = self.settings.width * radius
            low, high = np.empty((len(active), m), np.int64), np.empty((len(active), m), np.int64)
            for j in range(m):
                low[:, j] = np.searchsorted(self._sorted[j], centre[active, j] - reach, side="left")
                high[:, j] = np.searchsorted(self._sorted[j], centre[active, j] + reach, side="right")
            wide = (high - low == n).all(axis=1)
            size = (high - low).astype(self._place.dtype) if n < np.iinfo(self._place.dtype).max else high - low
            left = []
            for i, q in enumerate(active.tolist()):
                if wide[i]:
                    fresh = np.flatnonzero(~done[q])
                else:
                    np.subtract(self._place, low[i][:, None].astype(self._place.dtype), out=shifted)
                    np.less(shifted, size[i][:, None], out=inside)
                    fresh = np.flatnonzero((np.einsum("ij->j", inside.view(np.uint8)) >= self._enough) & ~done[q])
                if len(fresh):
                    done[q, fresh] = True
                    rows[q].append(fresh)
                    scores[q].append(self.vectors[fresh] @ queries[q])
                if wide[i] or self._settled(scores[q], rows[q], own[q], k, norm[q], radius):
                    continue
                left.append(q)
            active = np.array(left, dtype=np.int64)
            radius *= self.settings.growth
        return [self._best(rows[q], scores[q], queries[q], k + 1) for q in range(len(queries))]

    def _best(self, rows: list[np.ndarray], scores: list[np.ndarray], query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can be among the ``k`` best, all ties included, scored in one fixed order of summation, so equal vectors have equal scores."""
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0)
        found, score = np.concatenate(rows), np.concatenate(scores)
        if len(found) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            found = found[score >= least - 1e-9 * max(1.0, abs(least))]
        return found, (self.vectors[found] * query).sum(axis=1)

    def _settled(self, scores: list[np.ndarray], rows: list[np.ndarray], own: int, k: int, norm: float, radius: float) -> bool:
        found = sum(map(len, scores))
        if found <= k:
            return False
        s = np.concatenate(scores)[np.concatenate(rows) != own]
        if len(s) < k:
            return False
        worst = np.partition(s, len(s) - k)[len(s) - k]
        return 2 * self.largest**2 - 2 * self.largest * worst / norm <= radius**2


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it has components, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distinct(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One vector for each id, ascending; of several the smallest."""
    order = np.lexsort([*vectors.T[::-1], ids])
    first = np.concatenate([[True], ids[order][1:] != ids[order][:-1]])
    return ids[order][first], vectors[order][first]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, settings: Settings = Settings(), vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row for which ``queries`` holds.

    Candidates are all other rows with as many components. Ties go to the smaller id. Vectors that are null, zero or hold
    a null or non-finite component take no part, nor do rows without an id; of rows that share an id the smallest vector counts.
    A query with fewer candidates gets all of them. Other columns are not read.
    """
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"),
        F.size(vector).alias("dim"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max(norm).alias("largest")).collect()
    blocks = {r["dim"]: (-(-r["n"] // settings.block), -(-r["q"] // settings.query_block), r["largest"] * (1 + 1e-12)) for r in sizes if r["q"]}
    schema = "query_id long, vec_id long, score double"
    if not blocks:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = rows.sparkSession.createDataFrame([(d, *b) for d, b in blocks.items()], "dim int, blocks long, query_blocks long, largest double")
    placed = rows.join(F.broadcast(table), "dim")  # one row for each number of components
    # Rows that share an id meet in one block.
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), n)
    data = placed.select("dim", "id", "v", "largest", block(1, F.col("blocks")).alias("block"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("query_block"))
    asks = placed.where("asks").select(F.col("dim").alias("ask_dim"), F.col("id").alias("ask_id"), F.col("v").alias("ask_v"), block(2, F.col("query_blocks")).alias("ask_query_block"),
                                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("ask_block"))

    def cell(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x = _distinct(own["id"].to_numpy(), np.stack(own["v"].to_numpy()))
        query_ids, q = _distinct(asking["ask_id"].to_numpy(), np.stack(asking["ask_v"].to_numpy()))
        at = np.minimum(np.searchsorted(ids, query_ids), len(ids) - 1)
        itself = np.where(ids[at] == query_ids, at, -1)
        out = []
        for i, (found, score) in enumerate(Block(x, float(own["largest"].iloc[0]), settings).search(q, k, itself)):
            found, score = found[found != itself[i]], score[found != itself[i]]
            best = np.lexsort([ids[found], -score])[:k]
            out.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[found[best]], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    keys = ["dim", "block", "query_block"]
    found = data.groupBy(*keys).cogroup(asks.groupBy(*[f"ask_{k}" for k in keys])).applyInPandas(cell, schema)
    return top_n(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k, "rank").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
