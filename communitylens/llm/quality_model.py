"""Quality classifier: supervised subword embeddings.

A document's vector is the average of learned vectors of its hashed words
plus the average of those of its hashed character n-grams; a softmax layer
gives the classes.  Word, n-gram and output vectors are trained together by
stochastic gradient descent in numpy on a bounded, seeded sample of labelled
rows.  Since a document's vector is an average, its score is an average too:
the trained model folds into one number for each bucket, and scoring
is one table look-up for each word and character, dealt out by Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.llm.common import reliable

BUCKET_BITS = 17
GRAMS = (3, 4)
DIM = 16
EPOCHS = 5
RATE = 2.0
#: Labelled rows that a fit uses at most; documented bound of its sample.
MAX_TRAIN_ROWS = 2500
BATCH_CHARS = 2_000_000
SEED = 7
THRESHOLD = 0.3

_BLANK = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
#: Buckets of the two markers that are words of every text.
_END, _AGAIN = zlib.crc32(b"\x00end"), zlib.crc32(b"\x00again")


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def word_buckets(data: bytes) -> np.ndarray:
    """Buckets of a text's words; a word that repeats the one before it
    brings a marker word along, and every text ends with a marker."""
    h = np.fromiter(map(zlib.crc32, data.split()), dtype=np.uint32)
    again = np.count_nonzero(h[1:] == h[:-1]) if len(h) else 0
    return _bucket(np.concatenate((h, np.full(again, _AGAIN, np.uint32), np.array([_END], np.uint32))))


def gram_buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte of ``data``."""
    if len(data) < n:
        return np.zeros(0, np.uint32)
    h = np.full(len(data) - n + 1, n, dtype=np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) ^ data[k:len(data) - n + 1 + k]
    return _bucket(h ^ (h >> np.uint32(15)))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights: words share a weight of
    1, character n-grams another."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_BLANK)
    raw = np.frombuffer(data, dtype=np.uint8)
    ids, weights = [], []
    for field in (word_buckets(data), np.concatenate([gram_buckets(raw, n) for n in GRAMS])):
        if len(field):
            u, c = np.unique(field, return_counts=True)
            ids.append(u.astype(np.int32))
            weights.append((c / len(field)).astype(np.float32))
    return np.concatenate(ids), np.concatenate(weights)


@dataclass
class SubwordModel:
    vectors: np.ndarray  # a vector for each bucket
    output: np.ndarray   # DIM x classes
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """What one word or n-gram of each bucket adds to the log odds of
        class 1, before averaging."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)

    def log_odds_bias(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE,
          dim: int = DIM, seed: int = SEED) -> SubwordModel:
    """Plain SGD, one document a step, with a rate that falls to nothing.
    Without rows the model gives every text the odds 1 : 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    output, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, weights, label = rows[i]
            x = weights @ vectors[ids]
            z = x @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            lr = rate * (1 - step / steps)
            back = output @ p
            output -= lr * 0.1 * np.outer(x, p)
            bias -= lr * 0.02 * p
            vectors[ids] -= lr * np.outer(weights, back)
            step += 1
    return SubwordModel(vectors, output, bias)


def crc_remainder(doc_id, mod: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", fold_mod: int = 5,
                  max_rows: int = MAX_TRAIN_ROWS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and label of labelled documents outside the held-out fold:
    the ``max_rows`` labels first in md5 order of their id.  A document with
    several labels counts by the highest; null labels do not count.  A null
    text is the empty text; a repeated row trains as often as it comes; no
    rows or no labels give no sample."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .where(crc_remainder(F.col("doc_id"), fold_mod) != 0)
              .groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
              .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows))
    chosen = reliable(chosen)  # max_rows rows at most, so safe to broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([g[0].tobytes() for g in got], pa.binary()),
                 pa.array([g[1].tobytes() for g in got], pa.binary())], names=["doc_id", "label", "ids", "weights"])
    rows = sample.mapInArrow(run, "doc_id long, label int, ids binary, weights binary").toArrow()
    out = [(d, y, i, w) for d, y, i, w in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "label", "ids", "weights")))]
    out.sort()  # the same steps whatever order the tasks end in
    return [(np.frombuffer(i, np.int32), np.frombuffer(w, np.float32), min(1, max(0, y))) for _, y, i, w in out]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", **options) -> SubwordModel:
    return train(training_rows(docs, labels, label, **options))


def _score_batch(texts: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 for each text."""
    sums, sizes = np.zeros(len(texts)), np.zeros(len(texts))
    lens = np.array([len(t) for t in texts])
    stop = np.cumsum(lens)
    start = stop - lens
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    for n in GRAMS:
        have = np.maximum(lens - n + 1, 0)
        total = np.concatenate(([0.0], np.cumsum(table[gram_buckets(raw, n)])))
        at = np.minimum(start, len(total) - 1)  # a text without n-grams may begin behind the last one
        sums += np.where(have > 0, total[at + have] - total[at], 0.0)
        sizes += have
    words = np.array([table[word_buckets(t)].mean() for t in texts])
    return 1 / (1 + np.exp(-(bias + words + sums / np.maximum(sizes, 1))))


def score(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """The rows of ``docs`` as (row, score): probability of class 1.  A null
    text is the empty text; every text has a score."""
    table, bias = model.table(), model.log_odds_bias()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, held, size = [], [], 0
            for t in b.column("text"):
                held.append((t.as_py() or "").encode("utf-8", "surrogatepass").translate(_BLANK))
                size += len(held[-1])
                if size >= BATCH_CHARS:
                    scores.append(_score_batch(held, shared.value, bias))
                    held, size = [], 0
            if held:
                scores.append(_score_batch(held, shared.value, bias))
            got = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(got, pa.float64())], names=["row", "score"])
    schema = packed.select("row").schema.add("score", "double")
    return packed.mapInArrow(run, schema)


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows whose score reaches the threshold, columns as they came:
    repeated rows stay or go together, null and empty texts are scored like
    any text, and without labels every score is 0.5, so all rows stay."""
    return score(docs, fit(docs, labels, **options)).where(F.col("score") >= threshold).select("row.*")
