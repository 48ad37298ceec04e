"""Quality scores from random-indexing word vectors and a small neural network.

Random indexing gives each word (by hash, into ``WORDS`` buckets) a fixed sparse
vector of a few random signs; a word's vector is the sum of the index vectors of
its neighbours over the whole corpus. A document is the mean and the spread of
its words' vectors, with and without regard to neighbours. A two-layer network
in numpy learns quality from labelled documents, and a temperature fitted on
documents kept aside calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buswright.llm.common import fold, logistic, lower_ascii, row_starts, sampled, slices, table, utf8, without, word_bounds, word_hashes

#: Labelled documents to learn from, about, of either label.
SAMPLE = 1500
WORDS, WIDTH, SIGNS, REACH = 1 << 14, 32, 4, 2
#: Words that are worked on at a time, in one text or many.
_STRETCH = 1 << 16
FOLDS, HELD_OUT = 3, 1


def index_vectors() -> np.ndarray:
    """The fixed sparse vector of each word bucket."""
    rng = np.random.default_rng(5)
    out = np.zeros((WORDS, WIDTH), np.float32)
    at = rng.integers(0, WIDTH, (WORDS, SIGNS))
    np.add.at(out, (np.arange(WORDS)[:, None], at), rng.choice([-1.0, 1.0], (WORDS, SIGNS)).astype(np.float32))
    return out


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of all texts, and the texts' bounds in them."""
    data, bounds = utf8(texts)
    starts, ends, rows = word_bounds(data, bounds)
    hashes = word_hashes(lower_ascii(data), starts, ends)
    return (hashes % np.uint64(WORDS)).astype(np.int64), row_starts(rows, len(texts))


def neighbour_sums(words: np.ndarray, row: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The sum of the index vectors of the words of the same row up to ``REACH`` before and after each word."""
    own = index[words]
    out = np.zeros_like(own)
    for k in range(1, REACH + 1):
        same = (row[k:] == row[:-k])[:, None]
        out[k:] += own[:-k] * same
        out[:-k] += own[k:] * same
    return out


def _stretches(count: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of words to work on at a time: with their neighbours, and the place of their own in that."""
    for low in range(0, count, _STRETCH):
        high = min(low + _STRETCH, count)
        yield max(low - REACH, 0), min(high + REACH, count), low, high


def train_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors from the neighbours of all words of all texts, at unit length.

    Each task adds up a table of ``WORDS`` vectors; the tables are added in Spark
    and the sum, of that one size, comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((WORDS, WIDTH))
        for part in slices(batches, most=1_000_000):
            words, bounds = word_buckets(part.column("text"))
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for a, b, low, high in _stretches(len(words)):
                sums = neighbour_sums(words[a:b], row[a:b], index)[low - a : high - a]
                for k in range(WIDTH):
                    total[:, k] += np.bincount(words[low:high], sums[:, k], WORDS)
        used = np.flatnonzero(total.any(axis=1))
        values = pa.array(np.rint(total[used]).astype(np.int64).reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * WIDTH, pa.int32()), values)], names=["word", "v"])

    parts = docs.select("text").mapInArrow(run, "word long, v array<long>")
    sums = parts.groupBy("word").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(WIDTH)]).toArrow()
    out = np.zeros((WORDS, WIDTH), np.float32)
    if sums.num_rows:
        out[sums.column("word").to_numpy()] = np.stack([sums.column(f"v{k}").to_numpy() for k in range(WIDTH)], axis=1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean and spread of its word vectors, likeness of neighbouring
    words, length and share of words used once. All zero for a text without words."""
    words, bounds = word_buckets(texts)
    n, size = len(bounds) - 1, np.diff(bounds)
    out = np.zeros((n, 2 * WIDTH + 4), np.float32)
    some = size > 0
    if not some.any():
        return out
    count = size[some][:, None].astype(np.float64)
    row = np.repeat(np.arange(n), size)
    sums = np.zeros((n, 2 * WIDTH + 2))
    for low in range(0, len(words), _STRETCH):
        a, high = max(low - 1, 0), min(low + _STRETCH, len(words))
        own, mine = vectors[words[a:high]], row[a:high]
        before = mine[1:] == mine[:-1]
        values = np.zeros((high - a, 2 * WIDTH + 2), np.float32)
        values[:, :WIDTH], values[:, WIDTH : 2 * WIDTH] = own, own * own
        values[1:, -2] = (own[1:] * own[:-1]).sum(axis=1) * before
        values[1:, -1] = (words[a + 1 : high] == words[a : high - 1]) & before
        values, mine = values[low - a :], mine[low - a :]
        at = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        sums[mine[at]] += np.add.reduceat(values, at)
    sums = sums[some] / count
    mean = sums[:, :WIDTH]
    spread = np.sqrt(np.maximum(sums[:, WIDTH : 2 * WIDTH] - mean * mean, 0))
    distinct = np.bincount(np.unique(row * WORDS + words) // WORDS, minlength=n)[some]
    out[some] = np.concatenate([mean, spread, sums[:, -2:], distinct[:, None] / count, np.log1p(count) / 8], axis=1)
    return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(((x - self.centre) / self.scale) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.logits(x) / self.temperature)


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400) -> Network:
    """Learn from four fifths of the rows and fit the temperature on the rest."""
    rng = np.random.default_rng(3)
    x = x.astype(np.float64)
    centre, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    net = Network(centre, scale, layers)
    if not len(y) or y.min() == y.max():
        # one label only: its share is all there is to tell
        rate = (y.sum() + 1) / (len(y) + 2)
        net.layers[2], net.layers[3] = np.zeros(hidden), np.array(np.log(rate / (1 - rate)))
        return net
    aside = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    z, t = (x[~aside] - centre) / scale, y[~aside].astype(float)
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, rounds + 1):
        h = np.tanh(z @ layers[0] + layers[1])
        miss = (logistic(h @ layers[2] + layers[3]) - t) / len(t)
        inner = miss[:, None] * layers[2] * (1 - h * h)
        grads = [z.T @ inner + 1e-3 * layers[0], inner.sum(axis=0), h.T @ miss + 1e-3 * layers[2], miss.sum()]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            layers[i] = layers[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    if aside.any():
        logits, known = net.logits(x[aside]), y[aside].astype(float)
        tried = np.geomspace(0.25, 8, 60)
        net.temperature = float(min(tried, key=lambda k: (np.logaddexp(0, logits / k) - known * logits / k).mean()))
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """Learn from labelled documents outside the held-out fold, about ``sample`` of
    either label; their pooled vectors come to the driver. Rows without doc_id or
    label teach nothing; of rows that repeat a doc_id and label the one with the
    smallest pooled vector teaches."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", "quality")
    # about 2 * sample rows of two integers
    chosen = docs.select("doc_id", "text").join(F.broadcast(sampled(known, "quality", sample).distinct()), "doc_id")
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1_000_000):
            rows = [r.tobytes() for r in pooled(part.column("text"), held.value)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(rows, pa.binary())], names=["doc_id", "quality", "x"])

    rows = chosen.mapInArrow(run, "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    rows = rows.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, 2 * WIDTH + 4)
    order = np.random.default_rng(1).permutation(len(x))
    return fit(x[order], np.array(rows.column("quality").to_pylist(), dtype=int)[order])


def score(docs: DataFrame, network: Network, vectors: np.ndarray) -> DataFrame:
    """``docs`` with quality_score, the calibrated probability of label 1.

    Each row is scored by its whole text alone, very long ones a stretch of words at
    a time, so repeated rows repeat their score and ties need no order; null and
    empty texts have the score of a text without words. All columns of ``docs`` stay
    but one of the added name, which is replaced; an empty table gives an empty
    result. Vectors and network are of one size whatever the data.
    """
    held = docs.sparkSession.sparkContext.broadcast((network, vectors))
    docs = without(docs, "quality_score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, table_ = held.value
        for part in slices(batches, most=1_000_000):
            x = pooled(part.column(part.schema.get_field_index("text")), table_)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(net.score(x.astype(np.float64)))], names=[*names, "quality_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def op3_quality_network(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = train_vectors(docs)
    network = train(docs, table(spark, sf_dir, "labels"), vectors)
    out = score(docs.select("doc_id", "text"), network, vectors)
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
