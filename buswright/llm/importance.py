"""Drawing documents by how much likelier a target makes their n-grams.

Features are runs of one to three words, told apart by a bucket of the CRC-32 of
the run's bytes, words joined by a space. No run is ever made as a string: the CRC
of each word is computed once, and that of a run follows from its words', since
the CRC of ``a`` followed by ``b`` is the CRC of ``a``, put through as many steps
of the register as ``b`` has bytes, XOR that of ``b``. Such steps are a matrix over
GF(2) for each length; matrices are kept as four tables of 256 entries each.

A bucket's gain is the logarithm of its share in the target over its share in the
corpus, and a document's weight the sum of its features' gains. Adding Gumbel
noise made from a hash of the doc_id and taking the highest scores draws without
replacement in proportion to the exponentials of the weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buswright.llm.common import fresh, give_back, lower_ascii, materialise, slices, table, utf8

BUCKETS, WIDTH = 10_000, 3
SEED, PERCENT, LEAST_WORDS = 42, 5, 20
#: Bytes of texts that are worked on at a time.
STRETCH = 2_000_000
#: Words up to this length are hashed side by side, and runs up to it moved by a table of their own.
_SHORT = 64


def _one_step(register: np.ndarray) -> np.ndarray:
    """The register of CRC-32 after a byte of zeros."""
    return _BYTE[register & 0xFF] ^ (register >> np.uint32(8))


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0))
    return out


def _moved(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    """``register`` times the matrix whose four tables are the last two axes of ``tables``."""
    out = tables[..., 0, register & 0xFF]
    for k in range(1, 4):
        out = out ^ tables[..., k, (register >> np.uint32(8 * k)) & 0xFF]
    return out


_BYTE = _byte_table()


def _length_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables of the matrices for 0 to _SHORT bytes, and for 2**k bytes for each k under 40."""
    steps = [np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    while len(steps) <= _SHORT:
        steps.append(_one_step(steps[-1]))
    powers = [steps[1]]
    while len(powers) < 40:
        powers.append(_moved(powers[-1], powers[-1]))
    return np.stack(steps), np.stack(powers)


_STEPS, _POWERS = _length_tables()


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC put through ``lengths`` steps of the register."""
    at = np.minimum(lengths, _SHORT) * 1024
    flat, out = _STEPS.reshape(-1), np.zeros(len(crcs), np.uint32)
    for k in range(4):
        out ^= flat[at + 256 * k + ((crcs >> np.uint32(8 * k)) & 0xFF)]
    left = np.flatnonzero(lengths > _SHORT)
    for k in range(int(lengths.max(initial=0)).bit_length() if len(left) else 0):
        some = left[(lengths[left] - _SHORT) >> k & 1 == 1]
        out[some] = _moved(_POWERS[k], out[some])
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word, one byte of all words at a time; long words one by one."""
    lengths = ends - starts
    order = np.argsort(np.minimum(lengths, _SHORT + 1).astype(np.int16), kind="stable")[::-1]
    sizes, at = lengths[order], starts[order]
    long = int(np.searchsorted(-sizes, -_SHORT))
    register = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(sizes[long]) if long < len(sizes) else 0):
        stop = int(np.searchsorted(-sizes[long:], -j)) + long
        some = register[long:stop]
        register[long:stop] = _BYTE[(some ^ data[at[long:stop] + j]) & 0xFF] ^ (some >> np.uint32(8))
    register ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        register[i] = zlib.crc32(data[at[i] : at[i] + sizes[i]])
    out = np.empty(len(order), np.uint32)
    out[order] = register
    return out


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of digits, lower-case Latin letters and bytes from 0x80 on; rows end runs."""
    letter = np.zeros(256, bool)
    letter[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = letter[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[bounds < len(data)]
    begins[edges] = inside[edges]
    finish = inside[:-1] & ~inside[1:]
    last = edges[edges > 0] - 1
    finish[last] |= inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(bounds, starts, side="right") - 1


def run_crcs(crcs: np.ndarray, lengths: np.ndarray, rows: np.ndarray, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of words up to ``width``, the CRCs of all runs of so many words of a row and the place of each run's last word."""
    joined = shifted(np.full(len(crcs), zlib.crc32(b" "), np.uint32), lengths) ^ crcs
    out, run = [(crcs, np.arange(len(crcs)))], crcs
    for n in range(1, width):
        # run[i] ends in word i, for i from n - 1 on
        run = shifted(run[:-1], lengths[n:] + 1) ^ joined[n:]
        whole = np.flatnonzero(rows[n:] == rows[: len(rows) - n])
        out.append((run[whole], whole + n))
    return out


def _stretches(data: np.ndarray, at: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about ``at`` bytes that end between words."""
    start = 0
    while start < len(data):
        stop = start + at
        while stop < len(data):
            near = data[stop : stop + 4096]
            gaps = np.flatnonzero(~(((near >= 0x30) & (near < 0x3A)) | ((near >= 0x61) & (near < 0x7B)) | (near >= 0x80)))
            if len(gaps):
                stop += int(gaps[0])
                break
            stop += len(near)
        yield data[start : min(stop, len(data))]
        start = stop


def features(texts: pa.Array, buckets: int = BUCKETS, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of each stretch of a batch: the buckets of its features, their rows, and how many of them are words (which come first).

    A text longer than a stretch is taken in several; the runs across a cut are
    made in the later one, from the CRCs of the words before.
    """
    data, bounds = utf8(texts)
    data = lower_ascii(data)
    if len(bounds) == 2 and len(data) > STRETCH:
        crcs, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for piece in _stretches(data, STRETCH):
            starts, ends, _ = words_of(piece, np.array([0, len(piece)]))
            held = len(crcs)
            crcs, lengths = np.concatenate([crcs, word_crcs(piece, starts, ends)]), np.concatenate([lengths, ends - starts])
            runs = [run[last >= held] for run, last in run_crcs(crcs, lengths, np.zeros(len(crcs), np.int64), width)]
            found = np.concatenate(runs) % np.uint32(buckets)
            yield found, np.zeros(len(found), np.int64), len(runs[0])
            keep = max(0, len(crcs) - (width - 1))
            crcs, lengths = crcs[keep:], lengths[keep:]
        return
    starts, ends, rows = words_of(data, bounds)
    runs = run_crcs(word_crcs(data, starts, ends), ends - starts, rows, width)
    yield np.concatenate([run for run, _ in runs]) % np.uint32(buckets), np.concatenate([rows[last] for _, last in runs]), len(starts)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, width: int = WIDTH) -> np.ndarray:
    """How many features of all texts are in each bucket. A task adds up its own; ``buckets`` numbers come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, most=STRETCH):
            for found, _, _ in features(part.column(0), buckets, width):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    out = np.zeros(buckets, np.int64)
    rows = texts.select(F.col("text").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    for row in rows:
        out[row.bucket] = row.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target over that in the corpus, both counted from one, rounded down."""
    more_t, more_s = int(target.sum()) + len(target), int(corpus.sum()) + len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * more_s / ((s + 1) * more_t))) for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, by a hash of the doc_id."""
    known = F.coalesce(doc_id.cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), known).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """A row for each of ``docs``: doc_id, n_words, n_features, weight, score, and text_hash, which with doc_id finds its row again.

    ``docs`` has doc_id and text and ``target`` text; other columns are left out,
    whatever their names. Null texts are like empty ones: no feature, weight 0. The
    noise of a row without doc_id is that of an empty one; rows that repeat are
    rows of their own. Texts are read whole and in stretches, however long. An
    empty table gives an empty result, an empty target one without counts.
    """
    gain = gains(bucket_counts(target, buckets, width), bucket_counts(docs, buckets, width))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=STRETCH):
            n = part.num_rows
            words, all_, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for found, rows, few in features(part.column(part.schema.get_field_index("text")), buckets, width):
                all_ += np.bincount(rows, minlength=n)
                words += np.bincount(rows[:few], minlength=n)
                # sums of a stretch are far below 2**53, so doubles are exact
                weight += np.bincount(rows, weights=gain[found], minlength=n).astype(np.int64)
            columns = [part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("text_hash")), *(pa.array(x) for x in (words, all_, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_words", "n_features", "weight"])
        give_back()

    kind = dict(docs.select(F.col("doc_id").alias("doc_id")).dtypes)["doc_id"]
    given = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(F.col("text")).alias("text_hash"), F.col("text").alias("text"))
    out = given.mapInArrow(weigh, f"doc_id {kind}, text_hash long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """:func:`scored` with ``rank``: 1, 2, 3 and so on for the documents drawn, null for others.

    Of the documents of ``least_words`` words at least, ``percent`` in a hundred
    (rounded down) are drawn, by highest score, ties by smaller doc_id, rows
    without one last. Ranks come from a range sort: tasks number their own rows
    and begin where those before them end.
    """
    rows = materialise(scored(docs, target, **options).withColumn("tie", F.monotonically_increasing_id()), "importance-scores")
    counted = (F.col("n_words") >= least_words).alias("counted")
    rows = rows.withColumn("counted", counted).orderBy(F.desc("counted"), F.desc("score"), F.col("doc_id").asc_nulls_last(), "tie")
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()), "importance-order")
    # the upper bits are the number of the task, the lower 33 that of the row in it
    part = F.shiftright("at", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("counted").alias("of")).collect())
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row.part, before))
        before += row.n
    most = percent * sum(row.of for row in sizes) // 100
    starts = rows.sparkSession.createDataFrame(offsets, "part long, offset long")
    rank = F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    rows = rows.withColumn("part", part).join(F.broadcast(starts), "part")
    return rows.select("doc_id", "text_hash", "n_words", "n_features", "weight", "score", F.when(F.col("counted") & (rank <= most), rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns kept. Rows that are equal in doc_id and text are drawn together."""
    marks = drawn(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id"), F.col("text_hash").alias("drawn_hash"))
    marks = marks.distinct()
    key = fresh(docs, "text_hash")
    same = F.col("drawn_id").eqNullSafe(F.col("doc_id")) & (F.col("drawn_hash") == F.col(key))
    return docs.withColumn(key, F.xxhash64(F.col("text"))).join(marks, same, "left_semi").drop(key)


def op12_crc_resampling(spark, sf_dir: str) -> DataFrame:
    out = drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
