"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, for Java and DuckDB patterns alike.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Labels whose counts are sent to all tasks, some 1 MB.
BROADCAST_LABELS = 10_000
#: Keys that are sent to all tasks because very many rows have them (some 5 MB), and the least number of rows for it.
HOT_KEYS, HOT_LEAST = 50_000, 64


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, which
    has no other machine, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="buswright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. The caller's results may read it later,
    so it stays until the folder's owner clears it."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Where tables that materialise() wrote are, for release().
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(columns: DataFrame | list[str], name: str) -> str:
    """``name``, or a longer one where the columns have it already, in whatever case."""
    names = columns if isinstance(columns, list) else columns.columns
    taken = {c.lower() for c in names}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, *added: str) -> DataFrame:
    """``docs`` without columns of the names that a result adds: a result replaces them, as withColumn does."""
    gone = {a.lower() for a in added}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in gone])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id written in decimal, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def give_back() -> None:
    """Return to the system what earlier tasks of this worker have freed: workers are kept, and so would be their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2_000_000, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds at most ``rows`` rows and about ``most``
    bytes of ``column``, or a single row where that row alone is longer."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = utf8(batch.column(batch.schema.get_field_index(column)))[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(sizes, sizes[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row boundaries in them; null is empty."""
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    if array.null_count:
        array = array.fill_null("")
    bounds = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if array.buffers()[2] is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data`` and the row that each belongs to.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; rows end words too.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < n]
    begins[edges] = inside[edges]
    ends = np.zeros(n + 1, bool)
    ends[1:n] = inside[:-1] & ~inside[1:]
    ends[n] = inside[-1]
    inner = edges[edges > 0]
    ends[inner] |= inside[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(bounds, starts, side="right") - 1


def word_blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as blocks of eight bytes, the last filled up with zeros: all blocks, where each word's begin, how many it has."""
    lengths = ends - starts
    counts = (lengths + 7) >> 3
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), first, counts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    if total == len(starts):
        at, left = starts, lengths
    else:
        inside = 8 * (np.arange(total) - np.repeat(first, counts))
        at, left = np.repeat(starts, counts) + inside, np.repeat(lengths, counts) - inside
    keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
    return loads[at] & keep, first, counts


def block_hashes(blocks: np.ndarray, first: np.ndarray, counts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: every block is mixed with its place before blocks are added up."""
    out = np.zeros(len(counts), np.uint64)
    if len(blocks):
        place = np.arange(len(blocks)) - np.repeat(first, counts) if len(blocks) > len(counts) or (counts != 1).any() else 0
        salt = mixed(np.arange(1 + int(np.max(place, initial=0))) + (seed << 40) + 0x51ED)
        some = counts > 0
        out[some] = np.add.reduceat(mixed(blocks + salt[place]), first[some])
    return mixed(out + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word ``data[start:end]``; different seeds give independent ones.

    A hash tells words apart for counting features. Where words must not be
    confused, their bytes are compared (:mod:`buswright.llm.wordcache`).
    """
    return block_hashes(*word_blocks(data, starts, ends), ends - starts, seed)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + upper.astype(np.uint8) * np.uint8(32)


def row_starts(rows: np.ndarray, count: int) -> np.ndarray:
    """Where each of ``count`` rows begins in the sorted row numbers ``rows``; one end more."""
    return np.searchsorted(rows, np.arange(count + 1))


def sampled(rows: DataFrame, label: str, most: int, total: int | None = None) -> DataFrame:
    """Rows of a labelled table, about ``most`` of each label's at the most and about ``total`` of all labels'.

    A row is taken by the hash of its doc_id, so reruns agree. Counts cover all
    rows; shares of up to ``BROADCAST_LABELS`` labels are sent to all tasks, more
    are joined by a shuffle.
    """
    counts = rows.groupBy(label).count()
    held = counts.limit(BROADCAST_LABELS + 1).collect()
    few = len(held) <= BROADCAST_LABELS
    each = float(most if total is None else min(most, total / max(len(held) if few else counts.count(), 1)))
    share = fresh(rows, "share")
    shares = counts.select(label, (F.lit(each) / F.col("count")).alias(share))
    if few:
        shares = F.broadcast(rows.sparkSession.createDataFrame([(r[0], each / r[1]) for r in held], shares.schema))
    unit = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(17)), 11) / F.lit(float(1 << 53))
    return rows.join(shares, label).where(unit < F.col(share)).drop(share)


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, which has one row a key and in ``size`` the number of ``rows`` with it.

    Keys of very many rows would each make one task. They are at most
    ``HOT_KEYS`` by their least size, so they are sent to all tasks; other keys
    are joined by a shuffle, in which none has more rows than that.
    """
    hot = F.col(size) > max(HOT_LEAST, total // HOT_KEYS)
    often, rest = found.where(hot), found.where(~hot)
    first = rows.join(F.broadcast(often), keys)
    return first.unionByName(rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(rest, keys, how))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
