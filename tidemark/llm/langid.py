"""Language identification (operator 1).

A text is the mean of the embeddings of its subwords: byte n-grams inside words, word borders included, hashed into a fixed
number of buckets. A linear softmax over that mean names the language. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on windows of a bounded sample of rows; a temperature and a rejection threshold are then
calibrated on rows of the sample that were not trained on. For prediction the two linear maps fold into one table of a
logit per bucket and language.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import fresh, held_out, map_texts, sample
from tidemark.llm.hashing import LOWER, NON_LETTERS, chunks, layout

#: What is predicted when nothing can be: no text, no letter in it, or nothing to learn from.
UNDETERMINED = "und"
_GRAMS = (3, 4, 5)
_BORDER = np.uint8(0x20)
#: Rows of the training sample that only calibrate: one in so many.
_CALIBRATE = 5


@dataclass(frozen=True)
class Settings:
    """``per_language`` rows, twice as many at most, and ``longest`` characters of each bound the training sample; the rest are
    settings of the training. Every language has its column of weights."""

    per_language: int = 600
    longest: int = 12_000
    log2_buckets: int = 16
    dimensions: int = 16
    steps: int = 400
    batch: int = 32
    rate: float = 0.5
    window: tuple[int, int] = (24, 1500)
    precision: float = 0.99
    seed: int = 7


def subwords(texts: Sequence[str | None], log2_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of some texts, grouped by text, and the number of each text's subwords."""
    raw, offsets = layout(texts)
    gap = NON_LETTERS[raw]
    letters = np.where(gap, _BORDER, LOWER[raw])
    padded = np.concatenate([[_BORDER], letters, np.full(max(_GRAMS), _BORDER)]).astype(np.uint64)
    inner = np.concatenate([[False], ~gap, np.zeros(max(_GRAMS), bool)])
    n = len(raw) + 1
    found, owner = [], []
    solid = np.ones(n, dtype=bool)
    gram = padded[:n] | padded[1 : n + 1] << np.uint64(8)
    for size in range(3, max(_GRAMS) + 1):
        gram = gram | padded[size - 1 : size - 1 + n] << np.uint64(8 * (size - 1))
        solid = solid & inner[size - 2 : size - 2 + n]
        if size in _GRAMS:
            at = np.flatnonzero(solid)
            key = (gram[at] + np.uint64(size << 56)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((key >> np.uint64(64 - log2_buckets)).astype(np.int64))
            owner.append(np.searchsorted(at, offsets))
    counts = [np.diff(o) for o in owner]
    total = np.sum(counts, axis=0)
    if len(texts) == 1:
        return np.concatenate(found), total
    parts = [f[o[i] : o[i + 1]] for i in range(len(texts)) for f, o in zip(found, owner)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), total


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run has zero."""
    out = np.zeros((len(counts), values.shape[1]), dtype=np.float64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits, bucket x language
    bias: np.ndarray
    log2_buckets: int
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: Sequence[str | None]) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)))]
        for a, b in chunks(texts):
            buckets, counts = subwords(texts[a:b], self.log2_buckets)
            out.append(_sums(self.table[buckets], counts) / np.maximum(counts, 1)[:, None] + self.bias)
        return np.concatenate(out)

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best language, its calibrated probability, and whether that is enough to accept it."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        score = p[np.arange(len(best)), best]
        return [self.languages[i] for i in best.tolist()], score, score >= self.threshold


def _window(text: str, rng: np.random.Generator, low: int, high: int) -> str:
    size = int(np.exp(rng.uniform(np.log(low), np.log(high))))
    start = int(rng.integers(0, max(1, len(text) - size + 1)))
    return text[start : start + size]


def train(texts: Sequence[str], languages: Sequence[str], settings: Settings = Settings()) -> Model:
    """Fit on labelled texts; one in ``_CALIBRATE`` only calibrates. Without any row the model predicts nothing."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((1 << settings.log2_buckets, 0), np.float32), np.zeros(0), settings.log2_buckets)
    rng = np.random.default_rng(settings.seed)
    label = np.array([names.index(x) for x in languages])
    order = rng.permutation(len(texts))
    kept = order[len(order) // _CALIBRATE :]
    if len(set(label[kept].tolist())) < len(names):
        kept = order
    rows = [kept[label[kept] == k] for k in range(len(names))]
    n, d = 1 << settings.log2_buckets, settings.dimensions
    embedding = rng.normal(0, 0.1, (n, d)).astype(np.float32)
    weight = np.zeros((len(names), d), dtype=np.float32)
    weight[:] = rng.normal(0, 0.1, weight.shape)
    bias = np.zeros(len(names))
    square = np.full(n, 1e-6)  # of gradients by bucket
    for step in range(settings.steps):
        y = rng.integers(0, len(names), settings.batch)  # languages count alike
        batch = [_window(texts[int(rng.choice(rows[k]))], rng, *settings.window) for k in y.tolist()]
        buckets, counts = subwords(batch, settings.log2_buckets)
        if not len(buckets):
            continue
        share = 1.0 / np.maximum(counts, 1)
        mean = _sums(embedding[buckets], counts) * share[:, None]
        error = _softmax(mean @ weight.T + bias)
        error[np.arange(len(y)), y] -= 1
        rate = settings.rate * (1 - step / settings.steps)
        back = (error @ weight) * share[:, None]
        weight -= (rate * error.T @ mean / len(y)).astype(np.float32)
        bias -= rate * error.mean(axis=0)
        used, where = np.unique(buckets, return_inverse=True)
        owner = np.repeat(np.arange(len(counts)), counts)
        gradient = np.stack([np.bincount(where, back[owner, j], len(used)) for j in range(d)], axis=1)
        square[used] += (gradient**2).mean(axis=1)
        embedding[used] -= (rate * 0.2 * gradient / np.sqrt(square[used])[:, None]).astype(np.float32)
    model = Model(names, (embedding @ weight.T).astype(np.float32), bias, settings.log2_buckets)
    _calibrate(model, texts, label, order[: len(order) // _CALIBRATE], settings, rng)
    return model


def _calibrate(model: Model, texts: Sequence[str], label: np.ndarray, rows: np.ndarray, settings: Settings, rng) -> None:
    """Temperature of least log loss, then the lowest threshold at which accepted windows are right often enough."""
    if not len(rows):
        return
    z = model.logits([_window(texts[i], rng, *settings.window) for i in rows.tolist()])
    y = label[rows]
    scale = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in scale]
    model.temperature = float(scale[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    right = p.argmax(axis=1) == y
    order = np.argsort(-p.max(axis=1), kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= settings.precision)
    model.threshold = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the text and lang of a bounded sample of the rows outside the held-out fold.

    Long texts are cut to windows before they leave the executors; training draws its own short windows from them. An empty table, or
    one without a language, gives a model that predicts ``und``.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    got = sample(rows, "lang", settings.per_language, settings.seed, {"text": settings.longest})
    return train(got["text"].tolist(), got["lang"].tolist(), settings)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Language of every whole text: ``doc_id, held_out, lang_pred, score, accepted``.

    ``lang_pred`` is the best learned language, or ``und`` if the text is null or has no letter (score 0); ``score`` its
    calibrated probability. ``accepted`` is false where the score is below the calibrated rejection threshold. Every row gives one row, repeated ones
    and those without an id (never held out) too; of equal scores the language first in the alphabet wins.
    Texts are read whole, however long; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the data
    lettered = fresh("lettered", docs)

    def run(texts, batch):
        lang, score, accepted = shared.value.predict(texts)
        usable = np.array([bool(x) for x in batch.column(lettered).to_pylist()], dtype=bool)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": [x if ok else UNDETERMINED for x, ok in zip(lang, usable.tolist())],
                "score": np.where(usable, score, 0.0), "accepted": accepted & usable}

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"),
                       docs["text"].cast("string").alias("text"), F.rlike(docs["text"], F.lit(r"\p{L}")).alias(lettered))
    return map_texts(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
