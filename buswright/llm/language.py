"""Language identification by error-correcting output codes.

Every language has a codeword of bits; a binary n-gram classifier predicts each
bit from hashed n-grams of the text's bytes. Loss-weighted decoding adds up, for
each language, the logistic losses of all bits against its codeword, each bit
weighted by how well its classifier separates languages in training, and takes
the language of least loss. A text whose two best languages are nearly even is
flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buswright.llm.common import fold, fresh, logistic, lower_ascii, sampled, slices, table, utf8, without

#: Documents to learn from, about, of each language and of all languages.
SAMPLE, ALL_SAMPLES = 600, 6_000
#: Bytes that are counted at a time.
_STRETCH = 1 << 20
BUCKETS = 4096
GRAMS = (1, 2, 3, 4)
FOLDS, HELD_OUT = 3, 1
UNDETERMINED = "und"
#: Languages for which every split in two gets a bit; more get random splits.
_EXHAUSTIVE = 6


def codewords(count: int) -> np.ndarray:
    """A row of -1 and 1 for each language, far apart from each other.

    Up to six languages get every way to split them in two as a bit. More get
    ``12 + 6 log2(count)`` random even splits, the best of some draws.
    """
    if count <= _EXHAUSTIVE:
        splits = np.arange(1, 1 << max(count - 1, 0))
        bits = ((splits[None, :] >> np.arange(count)[:, None]) & 1) * 2 - 1
        return bits if count > 1 else np.ones((count, 1), int)
    rng, best, apart = np.random.default_rng(11), None, -1
    width = int(12 + 6 * np.ceil(np.log2(count)))
    for _ in range(60):
        drawn = np.stack([rng.permutation(np.where(np.arange(count) % 2 == 0, -1, 1)) for _ in range(width)], axis=1)
        nearest = ((width - drawn @ drawn.T) // 2 + width * np.eye(count, dtype=int)).min()
        if nearest > apart:
            best, apart = drawn, nearest
    return best


def profiles(texts: pa.Array) -> np.ndarray:
    """A row for each text: square roots of its n-gram counts by bucket, at unit length.

    Bytes are counted a stretch at a time, in one text or many.
    """
    data, bounds = utf8(texts)
    rows = len(bounds) - 1
    counts = np.zeros(rows * BUCKETS)
    for low in range(0, len(data), _STRETCH):
        part = lower_ascii(data[low : low + _STRETCH + GRAMS[-1] - 1])
        inside = np.diff(np.clip(bounds, low, min(low + _STRETCH, len(data))))
        row, left = np.repeat(np.arange(rows) * BUCKETS, inside), np.repeat(bounds[1:] - low, inside)
        left -= np.arange(len(left))
        key = np.zeros(len(part), np.uint32)
        for n in GRAMS:
            if len(part) < n:
                break
            key = key[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :] + np.uint32(1)
            own = key[: len(left)]
            keep = left[: len(own)] >= n
            bucket = (own * np.uint32(0x9E3779B1)) >> np.uint32(20)
            counts += np.bincount((row[: len(own)] + bucket)[keep], minlength=len(counts))
    out = np.sqrt(counts.reshape(rows, BUCKETS)).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Identifier:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    sharpness: float = 1.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        """The weighted loss of each language for each text."""
        margin = (x @ self.weights + self.bias)[:, None, :] * self.codes[None, :, :]
        return (np.logaddexp(0, -margin) * self.trust).sum(axis=2)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score in 0 to 1, and how far the second best is behind it in score."""
        loss = self.losses(x) * self.sharpness
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = share[np.arange(len(best)), best]
        share[np.arange(len(best)), best] = -1
        return best, top, top - np.maximum(share.max(axis=1), 0) if share.shape[1] > 1 else top


def fit(x: np.ndarray, names: list[str], rounds: int = 150) -> Identifier:
    languages = sorted(set(names))
    codes = codewords(len(languages))
    y = np.searchsorted(languages, names)
    target = (codes[y] + 1) / 2
    # every language weighs the same
    share = 1.0 / np.bincount(y)[y] / len(languages)
    w, b = np.zeros((x.shape[1], codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        miss = ((target - logistic(x @ w + b)) * share[:, None]).astype(np.float32)
        g = x.T @ miss - 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b += miss.sum(axis=0)
    right = ((x @ w + b) * codes[y] > 0).astype(float)
    per_language = np.stack([right[y == k].mean(axis=0) for k in range(len(languages))])
    trust = per_language / per_language.sum(axis=1, keepdims=True) * codes.shape[1]
    found = Identifier(languages, codes, w, b, trust)
    return found


def train(docs: DataFrame, sample: int = SAMPLE, total: int = ALL_SAMPLES) -> Identifier | None:
    """Learn from text and lang of documents outside the held-out fold, about ``sample``
    of each language and ``total`` of all; None where there is nothing to learn from. The
    sample's profiles, 8 kB a document, come to the driver. Rows without doc_id,
    lang, text or a letter teach nothing; of rows that repeat a doc_id and lang the
    one with the smallest profile teaches."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    known = sampled(known.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang"), "lang", sample, total).distinct()
    # about ``total`` rows of two values at the most
    chosen = docs.select("doc_id", "text", "lang").join(F.broadcast(known), ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=256):
            rows = [r.astype(np.float16).tobytes() for r in profiles(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(rows, pa.binary())], names=["doc_id", "lang", "profile"])

    rows = chosen.mapInArrow(run, "doc_id long, lang string, profile binary").groupBy("doc_id", "lang").agg(F.min("profile").alias("profile"))
    rows = rows.toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows.column("profile").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return fit(x, rows.column("lang").to_pylist())


def identify(docs: DataFrame, model: Identifier | None, margin: float = 0.2) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_ambiguous.

    Each row is judged by its whole text alone, very long ones a stretch of bytes at
    a time. A null text, one without a letter and any text where nothing was learned
    get ``und``, score 0 and are not ambiguous. Of languages that tie the first by
    name is taken; a text is ambiguous where the second language is less than
    ``margin`` behind in score. All columns of ``docs`` stay but those of the added
    names, which are replaced; rows that repeat repeat their results, and an empty
    table gives an empty result. The model is of one size for a number of languages.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = without(docs, "lang_pred", "lang_score", "lang_ambiguous")
    names = docs.columns
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_ambiguous", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches, rows=256):
            lettered = np.array(part.column(part.num_columns - 1).to_pylist(), bool)
            pred, score, close = np.full(part.num_rows, UNDETERMINED, object), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
            if model is not None and lettered.any():
                best, top, lead = model.predict(profiles(part.column(part.schema.get_field_index("text"))))
                pred[lettered] = np.array(model.languages, object)[best[lettered]]
                score[lettered], close[lettered] = top[lettered], lead[lettered] < margin
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score), pa.array(close)], names=[*names, "lang_pred", "lang_score", "lang_ambiguous"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(fresh(docs, "lettered"))
    return docs.select(*[F.col(f"`{c}`") for c in names], lettered).mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def op1_language_codes(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
