"""Document fingerprints by MinHash.

A text's shingles are its runs of five words (a shorter text is one shingle).
``PERMUTATIONS`` universal hash functions ``a x + b`` modulo the prime 2**31 - 1
permute the shingle hashes; a fingerprint is the smallest value of each, so two
fingerprints agree in about the share of places that is the Jaccard
similarity of their texts. Bands of the fingerprint are joined in Spark to find
near copies, which are verified on the shingles themselves (:mod:`buswright.llm.near_copies`).
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buswright.llm.common import lower_ascii, mixed, row_starts, slices, table, text_or_empty, utf8, word_bounds, word_hashes

PERMUTATIONS, SHINGLE, SEED = 64, 5, 20_240_229
BANDS, ROWS = 16, 4
SIMILARITY = 0.8
#: The value of every place in the fingerprint of a text without words.
_EMPTY = np.uint32(0xFFFFFFFF)
#: Shingles that are permuted at a time.
_STRETCH = 1 << 17
_PRIME, _SHIFT = np.uint64((1 << 31) - 1), np.uint64(31)


def permutations(count: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """``a`` and ``b`` of each function, both from 1 to the prime less 1."""
    rng = np.random.default_rng(SEED)
    return rng.integers(1, int(_PRIME), count, np.uint64), rng.integers(1, int(_PRIME), count, np.uint64)


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, which itself stands for zero."""
    x = (x & _PRIME) + (x >> _SHIFT)
    return (x & _PRIME) + (x >> _SHIFT)


def shingles(texts: pa.Array, width: int = SHINGLE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts, repeats included, and the texts' bounds in them.
    Different seeds give independent hashes.

    Words are lower-cased in ASCII. A text of fewer words than ``width`` is one
    shingle, one without words has none.
    """
    data, bounds = utf8(texts)
    starts, ends, rows = word_bounds(data, bounds)
    words = word_hashes(lower_ascii(data), starts, ends, seed)
    at = row_starts(rows, len(texts))
    size = np.diff(at)
    reach = np.minimum(np.repeat(size, size), width)
    key = np.zeros(len(words), np.uint64)
    for k in range(width):
        # short texts stop at their last word
        nxt = np.zeros(len(words), np.uint64)
        nxt[: max(len(words) - k, 0)] = words[k:]
        key = np.where(k < reach, mixed(key * np.uint64(0x9E3779B97F4A7C15) + nxt), key)
    place = np.arange(len(words)) - np.repeat(at[:-1], size)
    keep = place + reach <= np.repeat(size, size)
    return key[keep], np.r_[0, np.cumsum(np.where(size == 0, 0, np.maximum(size - width + 1, 1)))]


def signatures(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text: an array (texts, PERMUTATIONS)."""
    keys, bounds = shingles(texts)
    out = np.full((len(bounds) - 1, PERMUTATIONS), _EMPTY)
    some = np.diff(bounds) > 0
    if len(keys):
        x, at, known = _reduced(keys), bounds[:-1][some], np.flatnonzero(some)
        # a stretch of shingles at a time, so that a very long text needs no more arrays than a short one
        for low in range(0, len(x), _STRETCH):
            high = min(low + _STRETCH, len(x))
            rows = slice(int(np.searchsorted(at, low, side="right")) - 1, int(np.searchsorted(at, high)))
            begin, part, mine = np.maximum(at[rows], low) - low, x[low:high], known[rows]
            for k, (a, b) in enumerate(zip(*permutations(), strict=True)):
                least = np.minimum.reduceat(_reduced(a * part + b), begin).astype(np.uint32)
                out[mine, k] = np.minimum(out[mine, k], least)
    return out


def fingerprint_text(row: np.ndarray) -> str:
    return row.astype(">u4").tobytes().hex()


def _edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _parts(docs: DataFrame, rows: int = 4_000) -> tuple[DataFrame, int]:
    """``docs`` dealt into ranges of doc_id; the first of each range also ends the one before.

    Ranges are cut at doc_ids that occur, at approximate quantiles; the first
    range's first document ends the last range. ``__tail`` marks the rows that are
    there to be looked at only.
    """
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).first()
    count = max(1, min(-(-stats["n"] // rows), 20_000))
    if count > 1:
        grid = [i / count for i in range(1, count)]
        cuts = sorted({*docs.agg(F.percentile_approx("doc_id", grid, 100 * count).alias("q")).first()["q"]} - {stats["low"]})
    else:
        cuts = []
    size, first = len(cuts) + 1, F.col("doc_id").eqNullSafe(F.lit(stats["low"]))
    # a null doc_id sorts before all others
    part = F.lit(0)
    if cuts:
        # cuts are looked up in two steps, each of about the square root of their number
        step = math.isqrt(len(cuts)) + 1
        groups = [[int(c) for c in cuts[k : k + step]] for k in range(0, len(cuts), step)]
        heads = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
        group = F.size(F.filter(heads, lambda e: e <= F.col("doc_id")))
        own = F.get(F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>"), group - 1)
        found = (group - 1) * step + F.size(F.filter(own, lambda e: e <= F.col("doc_id")))
        part = F.when(F.col("doc_id").isNull() | (group < 1), F.lit(0)).otherwise(found)
        first = first | F.coalesce(F.array_contains(own, F.col("doc_id")), F.lit(False))
    own = F.struct(F.col("__part").alias("part"), F.lit(False).alias("tail"))
    before = F.struct(F.pmod(F.col("__part") - 1, F.lit(size)).alias("part"), F.lit(True).alias("tail"))
    dealt = docs.withColumn("__part", part).withColumn("__row", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    return dealt.select(*docs.columns, F.col("__row.part").alias("__part"), F.col("__row.tail").alias("__tail")), size


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    A text is edited by replacing its last quarter by the beginning of the next
    document's, in ascending doc_id; the first follows the last. Null counts as
    empty; a text without words has a fingerprint of its own, which equals that of
    other such texts alone. Rows that repeat a doc_id follow each other in the
    order of their texts; null doc_ids come first. A table of one row is followed
    by itself; an empty one gives an empty result.
    """
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    dealt, size = _parts(slim)
    order = ["__part", "__tail", F.col("doc_id").asc_nulls_first(), "text"]
    dealt = dealt.repartitionById(size, F.col("__part").cast("int")).sortWithinPartitions(*order)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row waits until the one after it has come: (doc_id, text, part, fingerprint)
        held = None
        for part in slices(batches, most=1_000_000):
            ids, texts, parts, tails = (part.column(i).to_pylist() for i in range(4))
            own = signatures(part.column("text"))
            rows = []
            for i in range(len(ids)):
                if held is not None and held[2] == parts[i]:
                    rows.append((held[0], held[1], held[3], _edited(held[1], texts[i]), own[i]))
                # of the rows at a part's end the first is the one that follows
                held = None if tails[i] else (ids[i], texts[i], parts[i], own[i])
            if rows:
                yield finished(rows)

    def finished(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, own, edited, following = zip(*rows, strict=True)
        own, following = np.stack(own), np.stack(following)
        changed = signatures(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([fingerprint_text(r) for r in own], pa.string()),
                pa.array([fingerprint_text(r) for r in changed], pa.string()),
                pa.array((own == changed).mean(axis=1)),
                pa.array((own == following).mean(axis=1)),
            ],
            names=[c.split()[0] for c in schema.split(", ")],
        )

    return dealt.mapInArrow(run, schema)


def bands(docs: DataFrame) -> DataFrame:
    """sig, doc, n, own, reach: an index entry for each band of each document's fingerprint.

    Texts without words and null doc_ids have none. n is the number of distinct
    shingles, all of which others may have (reach); own, of no use to bands, is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1_000_000):
            keys, bounds = shingles(part.column("text"))
            some = np.flatnonzero(np.diff(bounds) > 0)
            rows = signatures(part.column("text"))[some].astype(np.uint64)
            found = np.zeros((len(some), BANDS), np.uint64)
            for b in range(BANDS):
                for r in range(ROWS):
                    found[:, b] = mixed(found[:, b] * np.uint64(0x9E3779B97F4A7C15) + rows[:, b * ROWS + r] + np.uint64(b + 1))
            size = np.array([len(np.unique(keys[bounds[i] : bounds[i + 1]])) for i in some.tolist()], np.int64)
            ids = part.column("doc_id").cast(pa.int64()).take(pa.array(np.repeat(some, BANDS)))
            columns = [pa.array(found.reshape(-1).view(np.int64)), ids, pa.array(np.repeat(size, BANDS)), pa.array(np.zeros(len(some) * BANDS, np.int32)), pa.array(np.repeat(size, BANDS))]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "doc", "n", "own", "reach"])

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(run, "sig long, doc long, n long, own int, reach long")


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
