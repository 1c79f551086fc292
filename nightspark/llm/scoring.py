"""Pseudo-likelihood of documents under a bidirectional window network.

Words are hashed into a fixed number of buckets.  A small network reads the two
words on either side of a masked word and predicts its class; classes hold
buckets of like frequency, and a bucket's share of its class comes from counts
over the whole corpus, so probabilities are normalised over all buckets.  The
network is trained in numpy on every word of the corpus: each task trains a
copy on its rows, copies are averaged by a shuffle, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightspark.llm.common import binary_texts, cut, space_table, table, type_of
from nightspark.llm.hashing import some_bytes, word_hashes

SPACES = space_table()
SIDES = (-2, -1, 1, 2)


@dataclass(frozen=True)
class Shape:
    buckets: int = 8192
    width: int = 8
    hidden: int = 16
    classes: int = 32
    batch: int = 1024
    rate: float = 0.08
    rounds: int = 2

    @property
    def parts(self) -> list[tuple[int, ...]]:
        joined = len(SIDES) * self.width
        return [(self.buckets + 1, self.width), (joined, self.hidden), (self.hidden,), (self.hidden, self.classes), (self.classes,)]

    @property
    def size(self) -> int:
        return sum(int(np.prod(p)) for p in self.parts)

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        """Views of the network's parts: embedding, first layer and bias, second layer and bias."""
        cuts = np.cumsum([int(np.prod(p)) for p in self.parts])[:-1]
        return [x.reshape(p) for x, p in zip(np.split(flat, cuts), self.parts, strict=True)]

    def start(self) -> np.ndarray:
        rng = np.random.default_rng(17)
        flat = np.zeros(self.size, np.float32)
        for x in self.split(flat):
            if x.ndim == 2:
                x[:] = rng.normal(0, 1 / np.sqrt(x.shape[1 if len(x) > self.buckets else 0]), x.shape)
        return flat


def padded(texts: list[bytes | None], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids with two pads around every text, the places of words, and words per text."""
    words = word_hashes(texts, SPACES)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.full(int(sizes.sum()) + 2 * len(words) + 2, shape.buckets, np.int64)
    first = np.cumsum(sizes + 2) - sizes
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    if len(at):
        flat[at] = (np.concatenate(words) % np.uint64(shape.buckets)).astype(np.int64)
    return flat, at, sizes


def forward(parts: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joined embeddings, hidden layer, log-probabilities of classes."""
    embed, w1, b1, w2, b2 = parts
    joined = embed[context].reshape(len(context), -1)
    hidden = np.tanh(joined @ w1 + b1)
    out = hidden @ w2 + b2
    out -= out.max(axis=1, keepdims=True)
    out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
    return joined, hidden, out


def contexts(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([flat[at + s] for s in SIDES], axis=1)


class Trainer:
    """One task's copy: Adagrad on batches of words, shuffled within a block of texts."""

    def __init__(self, shape: Shape, flat: np.ndarray, class_of: np.ndarray) -> None:
        self.shape, self.class_of, self.flat = shape, class_of, flat.copy()
        self.parts = shape.split(self.flat)
        self.seen = np.full(shape.size, 1e-2, np.float32)
        self.sums = shape.split(self.seen)
        self.words, self.rng = 0, np.random.default_rng(23)

    def learn(self, texts: list[bytes | None]) -> None:
        flat, at, _ = padded(texts, self.shape)
        order = self.rng.permutation(len(at))
        for i in range(0, len(order), self.shape.batch):
            some = at[order[i : i + self.shape.batch]]
            self._step(contexts(flat, some), self.class_of[flat[some]])
        self.words += len(at)

    def _step(self, context: np.ndarray, target: np.ndarray) -> None:
        embed, w1, _, w2, _ = self.parts
        n = len(target)
        joined, hidden, out = forward(self.parts, context)
        slope = np.exp(out)
        slope[np.arange(n), target] -= 1
        slope /= n
        back = (slope @ w2.T) * (1 - hidden * hidden)
        spread = (back @ w1.T).reshape(-1, self.shape.width)
        rows = context.reshape(-1)
        touched, place = np.unique(rows, return_inverse=True)
        grad = np.stack([np.bincount(place, spread[:, k], len(touched)) for k in range(self.shape.width)], axis=1).astype(np.float32)
        # words are rare: a row moves by its summed slope, scaled by its own history
        self.sums[0][touched] += grad * grad
        embed[touched] -= self.shape.rate * grad / np.sqrt(self.sums[0][touched])
        for part, held, g in zip(self.parts[1:], self.sums[1:], (joined.T @ back, back.sum(0), hidden.T @ slope, slope.sum(0)), strict=True):
            held += g * g
            part -= self.shape.rate * g / np.sqrt(held)


def equal_mass_classes(counts: np.ndarray, classes: int) -> np.ndarray:
    """Class of each bucket: buckets by falling count, cut into classes of about equal mass (counts plus one)."""
    order = np.argsort(-counts, kind="stable")
    mass = np.cumsum(counts[order] + 1.0)
    out = np.empty(len(counts), np.int64)
    out[order] = np.minimum(((mass - (counts[order] + 1.0) / 2) / mass[-1] * classes).astype(np.int64), classes - 1)
    return out


@dataclass(frozen=True)
class Model:
    """A trained network; its size depends on its shape alone."""

    shape: Shape
    flat: np.ndarray
    class_of: np.ndarray
    share: np.ndarray

    def scores(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words and summed conditional log-probability of each text."""
        flat, at, sizes = padded(texts, self.shape)
        parts, value = self.shape.split(self.flat), np.empty(len(at))
        for i in range(0, len(at), self.shape.batch):
            some = at[i : i + self.shape.batch]
            own = flat[some]
            out = forward(parts, contexts(flat, some))[2]
            value[i : i + len(some)] = out[np.arange(len(some)), self.class_of[own]] + self.share[own]
        total = np.concatenate(([0.0], np.cumsum(value)))
        ends = np.cumsum(sizes)
        return sizes, total[ends] - total[ends - sizes]


def fit(docs: DataFrame, text: str = "text", shape: Shape | None = None) -> Model:
    """Train on all texts: one pass for counts, one a round for the network.

    The driver gets one number per bucket and one per weight, fixed by
    ``shape``; what tasks shuffle for them grows with the corpus.
    """
    shape = shape or Shape()
    spark = docs.sparkSession
    bodies = docs.select(F.col(text).alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape.buckets, np.int64)
        for batch in batches:
            texts = binary_texts(batch, "body")
            for lo, hi in some_bytes(texts):
                flat, at, _ = padded(texts[lo:hi], shape)
                total += np.bincount(flat[at], minlength=shape.buckets)
        here = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total[here])], ["bucket", "n"])

    counts = np.zeros(shape.buckets)
    for r in bodies.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    class_of = equal_mass_classes(counts, shape.classes)
    mass = np.bincount(class_of, counts + 1.0, shape.classes)
    share = np.log(counts + 1.0) - np.log(mass[class_of])
    # the pad is never predicted
    class_of, share = np.append(class_of, 0), np.append(share, 0.0)
    flat = shape.start()
    for _ in range(shape.rounds):
        sent = spark.sparkContext.broadcast((flat, class_of))

        def train(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Trainer(shape, *sent.value)
            for batch in batches:
                texts = binary_texts(batch, "body")
                for lo, hi in some_bytes(texts):
                    own.learn(texts[lo:hi])
            if own.words:
                moved = (own.flat.astype(np.float64) - sent.value[0]) * own.words
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(shape.size)), pa.array(moved), pa.array(np.full(shape.size, own.words))], ["at", "moved", "words"])

        merged = bodies.mapInArrow(train, "at long, moved double, words long").groupBy("at").agg(
            (F.sum("moved") / F.sum("words")).alias("moved"))
        got = cut(merged, "weights").toPandas()
        flat = flat.copy()
        flat[got["at"].to_numpy(np.int64)] += got["moved"].to_numpy(np.float32)
    return Model(shape, flat, class_of, share)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, log_likelihood (summed), per_word.

    Null, empty and blank texts: 0 words, 0.0, per_word null.  Words near an
    end have pads for the missing neighbours.  Null and repeated ids are kept,
    other columns ignored; no rows give no rows (and an untrained network).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_texts(batch, "body")
            found = [sent.value.scores(texts[lo:hi]) for lo, hi in some_bytes(texts)]
            n, total = (np.concatenate([np.asarray(x[k], kind) for x in found] or [np.empty(0, kind)]) for k, kind in ((0, np.int64), (1, np.float64)))
            with np.errstate(invalid="ignore"):
                mean = pa.array(np.round(total / np.maximum(n, 1), 6), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n), pa.array(np.round(total, 4)), mean], [doc_id, "n_words", "log_likelihood", "per_word"])

    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).mapInArrow(
        run, f"`{doc_id}` {type_of(docs, doc_id)}, n_words long, log_likelihood double, per_word double")


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
