"""Toxicity (operator 4): a convolutional classifier over hashed word embeddings.

A word's embedding is the sum of hashed vectors of the word and of its beginnings, so an unseen form of a known stem has
most of it. Filters of several widths slide over the words; each filter's largest answer in the text goes to a logistic
output. Everything is trained in numpy on a bounded sample of labelled rows. The output is then calibrated by language: a
slope and an offset for each language, fitted on rows that were not trained on, so that 0.5 is every language's threshold.
The language is the classifier's own guess, a naive Bayes over hashed words; no column but the text is read for a score.

For prediction a filter is one table look-up per word and position: word vectors are multiplied with all filter slices once
for each different word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import held_out, window
from tidemark.llm.hashing import NON_LETTERS, Words, chunks, mix

_PREFIXES = (3, 4, 5, 6)
_WIDTHS = (1, 2, 3)
#: Pads behind every text: filters start at its words and at the first pad, and never reach the next text.
_PAD = max(_WIDTHS)


@dataclass(frozen=True)
class Settings:
    """``per_label`` bounds the training sample (twice as many rows of each label at most), ``longest`` the characters of a row."""

    per_label: int = 3000
    longest: int = 30_000
    log2_buckets: int = 16
    dimensions: int = 12
    filters: int = 8
    epochs: int = 6
    most_steps: int = 500
    batch: int = 48
    rate: float = 0.05
    calibrate: int = 4  # one row in so many only calibrates
    least: int = 25  # rows of either label that a language needs for a calibration of its own
    seed: int = 11


class Batch:
    """Words of some texts: different words with their feature buckets, and each text's words as their numbers, padded at the end."""

    def __init__(self, texts: Sequence[str | None], log2_buckets: int):
        words = Words(texts, NON_LETTERS, lower=True)
        keys, where, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        start, size = words.start[where], (words.end - words.start)[where]
        shift = np.uint64(64 - log2_buckets)
        parts = [keys]
        for n in _PREFIXES:
            stem = mix(words.prefix.at(start, start + np.minimum(size, n)) + np.uint64(n))
            parts.append(np.where(size > n, stem, keys))  # a short word repeats itself
        self.features = np.stack([(p >> shift).astype(np.int32) for p in parts], axis=1)
        counts = np.diff(words.first)
        n = counts + _PAD
        self.ends = np.cumsum(n)
        self.starts = self.ends - n
        self.lasts = self.ends - (_PAD - 1)  # where filters no longer start
        self.sequence = np.full(int(n.sum()), len(keys), dtype=np.int32)  # the number after the last word is the pad
        at = np.repeat(self.starts - words.first[:-1], counts) + np.arange(len(inverse))
        self.sequence[at] = inverse
        self.counts, self.words = counts, inverse.astype(np.int32)


@dataclass
class Model:
    embedding: np.ndarray  # bucket x dimension
    filters: list[np.ndarray]  # one for each width: width x dimension x filters
    bias: list[np.ndarray]
    output: np.ndarray
    offset: float
    log2_buckets: int
    languages: np.ndarray | None = None  # bucket x language: log probability
    slope: np.ndarray = field(default_factory=lambda: np.ones(1))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def pooled(self, batch: Batch) -> np.ndarray:
        """Largest answer of every filter in every text."""
        vectors = self.embedding[batch.features].sum(axis=1)
        reach = np.stack([batch.starts, batch.lasts], axis=1).ravel()
        out = []
        for width, (f, b) in zip(_WIDTHS, zip(self.filters, self.bias)):
            answer = 0
            for j in range(width):
                slices = np.concatenate([vectors @ f[j], np.zeros((1, f.shape[2]), np.float32)])
                moved = slices[batch.sequence]
                answer = answer + (moved if j == 0 else np.concatenate([moved[j:], np.zeros((j, f.shape[2]), np.float32)]))
            out.append(np.maximum(np.maximum.reduceat(answer, reach, axis=0)[::2] + b, 0))
        return np.concatenate(out, axis=1)

    def language(self, batch: Batch) -> np.ndarray:
        """Number of the likeliest language; 0 for a text without words."""
        if self.languages is None or not len(batch.words):
            return np.zeros(len(batch.counts), dtype=np.int64)
        each = self.languages[batch.features[:, 0]][batch.words]
        out = np.zeros((len(batch.counts), each.shape[1]))
        some = batch.counts > 0
        out[some] = np.add.reduceat(each, (np.cumsum(batch.counts) - batch.counts)[some], axis=0)
        return out.argmax(axis=1)

    def raw(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated logits and language numbers."""
        z, lang = [np.zeros(0)], [np.zeros(0, np.int64)]
        for a, b in chunks(texts, 500_000):
            batch = Batch(texts[a:b], self.log2_buckets)
            z.append(self.pooled(batch) @ self.output + self.offset)
            lang.append(self.language(batch))
        return np.concatenate(z), np.concatenate(lang)

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        z, lang = self.raw(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope[lang] * z + self.shift[lang], -30, 30)))


def train(texts: Sequence[str], labels: Sequence[int], languages: Sequence[str | None], share: float, settings: Settings = Settings()) -> Model:
    """Fit on labelled texts; ``share`` is the share of label 1 among all labelled rows, which calibration restores.

    Without rows of both labels the score is a constant: ``share``.
    """
    rng = np.random.default_rng(settings.seed)
    y = np.asarray(labels, dtype=np.float64)
    n, d, k = 1 << settings.log2_buckets, settings.dimensions, settings.filters
    model = Model(rng.normal(0, 0.05, (n, d)).astype(np.float32),
                  [rng.normal(0, 0.5, (w, d, k)).astype(np.float32) for w in _WIDTHS], [np.zeros(k, np.float32) for _ in _WIDTHS],
                  np.zeros(k * len(_WIDTHS)), 0.0, settings.log2_buckets)
    order = rng.permutation(len(y))
    held, rows = order[: len(y) // settings.calibrate], order[len(y) // settings.calibrate :]
    if not (0 < y[rows].sum() < len(rows)) or not (0 < y[held].sum() < len(held)):
        model.shift[:] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return model
    batches = [rows[i : i + settings.batch] for i in range(0, len(rows), settings.batch)]
    ready = [Batch([texts[i] for i in b.tolist()], settings.log2_buckets) for b in batches]
    _start_from_frequencies(model, ready, [y[b] for b in batches])
    steps = min(settings.most_steps, settings.epochs * len(batches))
    square = np.full(n, 1e-4)
    moments = [np.full(f.shape, 1e-4) for f in model.filters], [np.full(b.shape, 1e-4) for b in model.bias], np.full(model.output.shape, 1e-4)
    for step in range(steps):
        if step % len(batches) == 0:
            turn = rng.permutation(len(batches))
        i = int(turn[step % len(batches)])
        _step(model, ready[i], y[batches[i]], settings.rate * (1 - 0.9 * step / steps), square, moments)
    _learn_languages(model, texts, languages, rows)
    _calibrate(model, [texts[i] for i in held.tolist()], y[held], share, settings)
    return model


def _start_from_frequencies(model: Model, batches: list[Batch], labels: list[np.ndarray]) -> None:
    """First dimension of each bucket: log odds of texts with label 1 among the texts that have it; filters start by looking at it."""
    n = len(model.embedding)
    count = np.full((2, n), 4.0)
    for batch, y in zip(batches, labels):
        owner = np.repeat(np.arange(len(batch.counts)), batch.counts)
        features = batch.features[batch.words]
        pairs = np.unique((owner[:, None] * n + features).ravel())
        for label in (0, 1):
            count[label] += np.bincount(pairs[y[pairs // n] == label] % n, minlength=n)
    total = np.array([sum((y == label).sum() for y in labels) for label in (0, 1)]) + 8.0
    model.embedding[:, 0] = np.clip(np.log(count[1] / total[1]) - np.log(count[0] / total[0]), -2, 2) / (1 + len(_PREFIXES))
    for f in model.filters:
        f[:, 0, : f.shape[2] // 2] = np.abs(f[:, 0, : f.shape[2] // 2]) + 1
    model.output[:] = 0.3


def _step(model: Model, batch: Batch, y: np.ndarray, rate: float, square: np.ndarray, moments: tuple) -> None:
    """One step of adaptive gradient descent; only the words that won the pooling take part in it."""
    vectors = np.concatenate([model.embedding[batch.features].sum(axis=1), np.zeros((1, model.embedding.shape[1]), np.float32)])
    answers, winners = [], []
    for width, f, b in zip(_WIDTHS, model.filters, model.bias):
        total = np.zeros((len(batch.sequence), f.shape[2]), np.float32)
        for j in range(width):
            moved = (vectors @ f[j])[batch.sequence]
            total[: len(total) - j] += moved[j:]
        at = np.stack([s + total[s:e].argmax(axis=0) for s, e in zip(batch.starts.tolist(), batch.lasts.tolist())])
        winners.append(at)
        answers.append(np.take_along_axis(total, at, axis=0) + b)
    pre = np.concatenate(answers, axis=1)
    hidden = np.maximum(pre, 0)
    error = (1 / (1 + np.exp(-np.clip(hidden @ model.output + model.offset, -30, 30))) - y) / len(y)
    back = np.outer(error, model.output) * (pre > 0)
    gradient = hidden.T @ error + 1e-4 * model.output
    moments[2][:] += gradient**2
    model.output -= rate * gradient / np.sqrt(moments[2])
    model.offset -= rate * float(error.sum())
    touched, pushes = [], []
    k = model.filters[0].shape[2]
    for i, width in enumerate(_WIDTHS):
        own, at, f = back[:, i * k : (i + 1) * k], winners[i], model.filters[i]
        step = np.zeros_like(f)
        for j in range(width):
            word = batch.sequence[np.minimum(at + j, len(batch.sequence) - 1)]
            step[j] = np.einsum("nk,nkd->dk", own, vectors[word])
            real = (word < len(vectors) - 1) & (own != 0)
            touched.append(word[real])
            pushes.append((own[:, :, None] * f[j].T[None])[real])
        moments[0][i] += step**2
        model.filters[i] = (f - rate * step / np.sqrt(moments[0][i])).astype(np.float32)
        lift = own.sum(axis=0)
        moments[1][i] += lift**2
        model.bias[i] = (model.bias[i] - rate * lift / np.sqrt(moments[1][i])).astype(np.float32)
    word, push = np.concatenate(touched), np.concatenate(pushes)
    if not len(word):
        return
    bucket = batch.features[word].ravel()
    push = np.repeat(push, batch.features.shape[1], axis=0)
    used, where = np.unique(bucket, return_inverse=True)
    gradient = np.stack([np.bincount(where, push[:, j], len(used)) for j in range(push.shape[1])], axis=1)
    square[used] += (gradient**2).mean(axis=1)
    model.embedding[used] -= (0.3 * rate * gradient / np.sqrt(square[used])[:, None]).astype(np.float32)


def _learn_languages(model: Model, texts: Sequence[str], languages: Sequence[str | None], rows: np.ndarray) -> None:
    names = sorted({x for x in languages if x is not None})
    if len(names) < 2:
        return
    count = np.full((len(model.embedding), len(names)), 0.1)
    for i in rows.tolist():
        if languages[i] is not None:
            batch = Batch([texts[i]], model.log2_buckets)
            np.add.at(count[:, names.index(languages[i])], batch.features[batch.words, 0], 1)
    model.languages = np.log(count / count.sum(axis=0)).astype(np.float32)


def _calibrate(model: Model, texts: Sequence[str], y: np.ndarray, share: float, settings: Settings) -> None:
    """Slope and offset of each language, by weighted logistic regression on held rows; small languages take the common ones."""
    z, lang = model.raw(texts)
    names = 1 if model.languages is None else model.languages.shape[1]
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    common = _logistic(z, y, weight)
    fitted = []
    for i in range(names):
        own = lang == i
        enough = min((y[own] == 1).sum(), (y[own] == 0).sum()) >= settings.least
        fitted.append(_logistic(z[own], y[own], weight[own]) if enough else common)
    model.slope, model.shift = np.array([f[0] for f in fitted]), np.array([f[1] for f in fitted])


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge, so that separable rows keep a finite slope; the slope is never negative."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (p - y) * z).sum() + 0.02 * a, (weight * (p - y)).sum() + 1e-4 * b])
        h = weight * p * (1 - p)
        m = np.array([[(h * z * z).sum() + 0.02, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(m, g)
        limit = max(1.0, np.abs(step).max() / 4)
        a, b = a - step[0] / limit, b - step[1] / limit
        if np.abs(step).max() < 1e-7:
            break
    if a < 0:
        rate = np.average(y, weights=weight)
        return 0.0, float(np.log(rate / (1 - rate)))
    return float(a), float(b)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[pd.DataFrame, float]:
    """The sample that is learned from (``text, toxic, lang``) and the share of label 1 among all labelled ids outside the held-out fold.

    Ids are drawn by a hash among the labels, which are small, before they meet the texts. Equal labels of an id count once, and so do equal
    texts of a label, whatever their ids; each label is then cut on its own, lowest hash of the text first. So neither a repeated label, a
    repeated id nor a text with many copies takes more than one place, and the choice depends neither on partitioning nor on the
    order of rows. Of a text longer than ``longest`` characters a window is taken, at a place drawn by its hash.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    rows = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return pd.DataFrame(columns=["text", "toxic", "lang"]), 0.0
    draw = F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(min(1.0, settings.per_label / n))) for k, n in totals.items()])
    # At most twice ``per_label`` ids of each label, lowest hashes first: a proven bound, so they are sent to the texts.
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(draw, "doc_id"))
    drawn = known.where(draw < share).withColumn("rank", rank).where(F.col("rank") <= 2 * settings.per_label).drop("rank")
    met = rows.join(F.broadcast(drawn), "doc_id")
    folded = met.groupBy("toxic", "text").agg(F.min("lang").alias("lang")).withColumn("draw", F.xxhash64(F.lit(settings.seed), "text"))
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "text"))
    cut = folded.withColumn("place", place).where(F.col("place") <= 2 * settings.per_label)
    got = cut.select(window(F.col("text"), settings.longest, settings.seed).alias("text"), "toxic", "lang").toPandas()
    return got.sort_values(["toxic", "text"], kind="stable").reset_index(drop=True), totals.get(1, 0) / sum(totals.values())


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from labelled documents outside the held-out fold (``training_rows``); labels other than 0 and 1 and null texts are left out."""
    got, rate = training_rows(docs, labels, settings)
    return train(got["text"].tolist(), got["toxic"].tolist(), [x if isinstance(x, str) else None for x in got["lang"]], rate, settings)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Column of the probability of label 1 for every whole text; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size, whatever the data

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(texts.tolist()), dtype="float64")

    return probability(docs[text].cast("string"))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; ``predicted`` is 1 if the score is 0.5 or more.

    Empty and null texts have a score too. Each row is scored by itself, so repeated rows and rows without an id (never
    held out) stay; columns other than ``doc_id`` and ``text`` are not read. Texts are read whole, however long; an empty table gives
    an empty one, and without labels every score is the same.
    """
    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"),
                         score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is below 0.5, with all their columns."""
    return docs.where(score(docs, model) < 0.5)
