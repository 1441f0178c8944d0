"""Whitening of embeddings (operator 12): leading eigenpairs of the covariance by spectrum slicing.

Vectors become whole numbers, each different vector counts once, and sums and centred products are gathered in Spark: a
task reduces its rows to one matrix, matrix entries are added up by key. What reaches the driver is one matrix of the
vectors' dimension, whatever the number of rows.

On the driver the leading eigenvalues are isolated by inertia: the signs of the pivots of the LDL' factors of ``V - s I`` tell how
many eigenvalues lie above ``s``. Bisection by such counts gives each wanted eigenvalue an interval of its own (or leaves a
cluster too narrow to part); Rayleigh quotient iteration then converges cubically inside it, and two more counts beside the
result certify that it is the k-th one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import stage

#: Components that are returned.
COMPONENTS = 4
#: Entries are multiplied by this before they are rounded down.
SCALE = 256
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
_LARGEST = float(1 << 53)
_EPS = float(np.finfo(np.float64).eps)


def factor(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (unit lower triangle) and pivots D of a symmetric matrix, ``a = L D L'``, without exchanges; a pivot of nothing is replaced by a tiny one."""
    rest, n = a.copy(), len(a)
    lower, pivots = np.eye(n), np.empty(n)
    tiny = _EPS * max(float(np.abs(a).max()), np.finfo(np.float64).tiny)
    for j in range(n):
        d = rest[j, j]
        pivots[j] = d if abs(d) > tiny else (tiny if d >= 0 else -tiny)
        column = rest[j + 1:, j] / pivots[j]
        lower[j + 1:, j] = column
        rest[j + 1:, j + 1:] -= np.outer(column, rest[j + 1:, j])
    return lower, pivots


def positive_pivots(a: np.ndarray) -> int:
    """Number of positive pivots with complete exchanges, D having blocks of one or two rows (a block of two has one of either sign)."""
    rest, positive = a.copy(), 0
    while len(rest):
        sizes = np.abs(rest)
        diagonal = np.diagonal(sizes)
        r = int(diagonal.argmax())
        p, q = np.unravel_index(int(np.triu(sizes, 1).argmax()), rest.shape)
        if diagonal[r] == 0 and sizes[p, q] == 0:
            return positive
        # Fixed value: the bound (1 + sqrt 17) / 8 keeps the growth of either kind of step alike.
        out = [r] if diagonal[r] >= (1 + 17**0.5) / 8 * sizes[p, q] else [p, q]
        stay = np.setdiff1d(np.arange(len(rest)), out)
        block, beside = rest[np.ix_(out, out)], rest[np.ix_(stay, out)]
        positive += int(block[0, 0] > 0) if len(out) == 1 else 1
        rest = rest[np.ix_(stay, stay)] - beside @ np.linalg.solve(block, beside.T)
        rest = (rest + rest.T) / 2
    return positive


class Slicer:
    """Counts of the eigenvalues of a symmetric matrix above a shift."""

    def __init__(self, v: np.ndarray):
        self.v, self.norm = v, float(np.abs(v).sum(axis=1).max()) if len(v) else 0.0
        self.factored = 0

    def above(self, shift: float) -> int:
        """How many eigenvalues are larger than the shift (Sylvester's law of inertia).

        Without exchanges the factors can grow; they count only if they give the matrix back, else exchanges are made.
        """
        a = self.v - shift * np.eye(len(self.v))
        self.factored += 1
        lower, pivots = factor(a)
        if np.abs((lower * pivots) @ lower.T - a).max() <= 1e-13 * self.norm:
            return int((pivots > 0).sum())
        return positive_pivots(a)

    def isolate(self, k: int, high: float) -> tuple[float, float]:
        """An interval that holds the k-th largest eigenvalue alone, or is as narrow as rounding allows."""
        low = -self.norm
        while self.above(low) < k:  # pragma: no cover - the norm bounds the spectrum
            low = 2 * low - 1
        while high - low > 64 * _EPS * self.norm:
            if self.above(high) == k - 1 and self.above(low) == k:
                break
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)
        return low, high

    def rayleigh(self, low: float, high: float, found: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration from the middle of an interval, among what is orthogonal to the eigenvectors found before."""
        n = len(self.v)
        x = np.random.default_rng(seed).standard_normal(n)
        shift, before = (low + high) / 2, np.inf
        for step in range(60):
            a = self.v - shift * np.eye(n)
            try:
                y = np.linalg.solve(a, x)
            except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
                y = np.linalg.solve(a + 4 * _EPS * self.norm * np.eye(n), x)
            for _ in range(2):
                y -= found.T @ (found @ y)
            x = y / np.linalg.norm(y)
            quotient = float(x @ self.v @ x)
            left = float(np.linalg.norm(self.v @ x - quotient * x))
            if left <= 4 * _EPS * self.norm or (step > 3 and left >= before / 2 and left <= 1e-12 * self.norm):
                return quotient, x
            before = left
            if low <= quotient <= high or step < 2:
                shift = min(max(quotient, low), high) if step >= 2 else shift  # two steps at the middle first
        return quotient, x

    def leading(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest eigenvalues, falling, and their eigenvectors as rows, sign by the largest entry; only those that are not nothing."""
        values, vectors = [], np.zeros((0, len(self.v)))
        high = self.norm * (1 + 8 * _EPS)
        slack = 256 * _EPS * self.norm
        for k in range(1, min(wanted, len(self.v)) + 1):
            if self.norm == 0 or self.above(len(self.v) * 64 * _EPS * self.norm) < k:
                break
            low, high = self.isolate(k, high)
            while True:
                value, x = self.rayleigh(low, high, vectors, k)
                certain = self.above(value + slack) <= k - 1 and self.above(value - slack) >= k
                if certain:
                    break
                if high - low <= slack:
                    raise ArithmeticError(f"eigenvalue {k} cannot be certified")
                middle = (low + high) / 2  # the iteration ran to another eigenvalue: start from closer
                low, high = (middle, high) if self.above(middle) >= k else (low, middle)
            x = x * (1.0 if x[np.abs(x).argmax()] > 0 else -1.0)
            values.append(value)
            vectors = np.vstack([vectors, x])
            high = min(high, value + slack)
        return np.array(values), vectors


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch by the length of their vectors: places, and the vectors as a matrix of whole numbers."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    flat, first = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[first[at][:, None] + np.arange(size)]


def rounded(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and whole numbers ``x`` of the vectors that count; see ``whiten``."""
    entries = F.col("v").cast("array<double>")
    whole = F.transform(entries, lambda c: F.floor(c * SCALE))
    fits = F.forall(entries, lambda c: F.coalesce(F.abs(c * SCALE) < _LARGEST, F.lit(False)))  # null, NaN and infinite ones fail too
    picked = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return picked.where(F.col("v").isNotNull() & (F.size("v") > 0) & fits).select("vec_id", whole.alias("x"))


def _summed(rows: DataFrame, reduce, schema: str) -> DataFrame:
    """Apply a function that turns batches into a few (keys, value) rows; the values are added up by the keys."""
    parts = rows.mapInArrow(reduce, schema)
    keys = [c for c in parts.columns if c != "value"]
    return parts.groupBy(*keys).agg(F.sum("value").alias("value"))


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _sums(different: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: number of vectors and exact sums of their entries."""
    text = "size int, place int, value decimal(38,0)"
    schema = _arrow(text)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch, "x"):
                safe = len(x) * max(int(np.abs(x).max()), 1) < 1 << 62
                own = np.array([len(x), *(x.sum(axis=0) if safe else x.astype(object).sum(axis=0)).tolist()], dtype=object)
                totals[x.shape[1]] = totals[x.shape[1]] + own if x.shape[1] in totals else own
        for size, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(total), pa.int32()), pa.array(range(-1, len(total) - 1), pa.int32()),
                                              pa.array(total.tolist(), pa.decimal128(38, 0))], schema=schema)

    out: dict[int, tuple[int, list[int]]] = {}
    for size, _, value in sorted(map(tuple, _summed(different, reduce, text).collect())):  # one row for each dimension
        out.setdefault(size, []).append(int(value))
    return {size: (values[0], values[1:]) for size, values in out.items()}


def _products(different: DataFrame, centred) -> dict[int, np.ndarray]:
    """By length: the sum of ``z z'`` over the vectors, ``z = centred(x)``; upper triangles are added up in Spark."""
    text = "size int, i int, j int, value double"
    schema = _arrow(text)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch, "x"):
                z = centred(x)
                if z is not None:
                    totals[x.shape[1]] = totals.get(x.shape[1], 0.0) + z.T @ z
        for size, total in totals.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array(total[i, j])], schema=schema)

    out: dict[int, dict] = {}
    for size, i, j, value in map(tuple, _summed(different, reduce, text).collect()):  # one row for each entry of the matrix
        out.setdefault(size, {})[i, j] = value
    full = {}
    for size, entries in out.items():
        m = np.zeros((1 + max(i for i, _ in entries),) * 2)
        for (i, j), value in entries.items():
            m[i, j] = m[j, i] = value
        full[size] = m
    return full


class Fit:
    """What whitens vectors of one length: ``n``, sums, mean, eigenvectors as rows, eigenvalues, their share of the trace."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray):
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums])  # true division of whole numbers rounds once
        self.values, self.vectors = Slicer(covariance).leading(COMPONENTS)
        self.explained = self.values / np.trace(covariance) if len(self.values) else self.values
        self.error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of ``(n x - S)^2``, exactly; None where it exceeds a long."""
        n, s = self.n, np.array(self.sums, dtype=object)
        most = n * int(np.abs(x).max()) + max(map(abs, self.sums)) if x.size else 0
        if most * most * x.shape[1] < 1 << 63:
            return ((n * x - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * n - s) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]


def fit(different: DataFrame) -> dict[int, Fit]:
    """Fits by length of vector, from the different whole-number vectors (``x``)."""
    sums = _sums(different)
    means = {size: np.array([s / n for s in total]) for size, (n, total) in sums.items()}
    products = _products(different, lambda x: x - means[x.shape[1]])
    fits = {size: Fit(n, total, products[size] / n) for size, (n, total) in sums.items()}
    measured = _products(different, lambda x: fits[x.shape[1]].whitened(x) if len(fits[x.shape[1]].values) else None)
    for size, m in measured.items():
        fits[size].error = float(np.abs(m / fits[size].n - np.eye(len(m))).max())
    return fits


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened leading components (``SCHEMA``) of every vector; one row for each component, at most four.

    Vectors that are null or empty, or hold null, NaN, infinite entries or entries of 2**45 and more (their whole numbers would
    not be exact as doubles), have no rows. Vectors of another length are a space of their own, with its own fit. Repeated rows
    and ids are returned as often as they stand, and count once in the fit. Components whose eigenvalue is nothing (all vectors
    equal, or in a plane) are left out. ``deviation`` is null where it exceeds a long. Equal eigenvalues share a space: any
    orthonormal vectors of it may stand for them, the same ones for all rows.

    The different vectors are staged and read three times (sums, products, measured error); the last pass reads the given rows.
    """
    rows = rounded(vectors, vec_id, vector)
    fits = fit(stage(rows.select("x").distinct(), "different-vectors"))
    schema = _arrow(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, "x"):
                f = fits[x.shape[1]]
                w = f.whitened(x)
                m = w.shape[1]
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, m)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, m + 1), len(at)), pa.int32()), pa.array(np.full(m * len(at), f.n)),
                    pa.array([d for d in f.deviation(x) for _ in range(m)], pa.int64()), pa.array(w.ravel()),
                    pa.array(np.tile(f.explained, len(at))), pa.array(np.full(m * len(at), f.error))], schema=schema)

    return rows.mapInArrow(run, SCHEMA)
