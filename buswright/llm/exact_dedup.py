"""Exact deduplication on an extendible-hash index.

Every text gets a 64-bit key. A directory over the leading bits of the key
starts as one bucket and doubles while a bucket holds more than ``capacity``
pages of text, so a dense stretch of keys gets more owners than a sparse one. Rows go
to the owner of their bucket, which is a range of keys. The owner sorts a bucket by
key and by the bytes of the normalised texts: texts that share a key are chained, and
a text's place in the chain, not its key, says which rows are its copies.

A bucket that the directory can split no further is full of copies or of one
key. Its copies are combined before they move, so a text that a third of all
rows repeat reaches its owner as one row a task, and its rows look their chain up
in the owner's entries.

All of it is DataFrame functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buswright.llm.common import SPACE_CLASS, looked_up, materialise, release, table, text_or_empty

#: Bytes of a page, by which texts are counted besides their number.
PAGE = 4096
#: Cells of the directory at the most, and at what pages a bucket splits, at the least.
MOST_DEPTH, LEAST_CAPACITY = 16, 256
#: Rows to drop that are sent to all tasks (some 16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    """Text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(text, SPACE_CLASS, "")


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth)


def directory(histogram: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """Buckets as (first prefix, last prefix, local depth) by directory doubling.

    ``histogram`` counts pages by the leading ``depth`` bits. A bucket over
    ``capacity`` splits in two by its next bit, until it fits or no bit is left;
    what then is still overfull is full of copies or of one key.
    """
    sums = [0]
    for p in range(1 << depth):
        sums.append(sums[-1] + histogram.get(p, 0))
    done, open_ = [], [(0, (1 << depth) - 1, 0)]
    while open_:
        low, high, local = open_.pop()
        if local == depth or sums[high + 1] - sums[low] <= capacity:
            done.append((low, high, local))
        else:
            middle = (low + high) // 2
            open_ += [(middle + 1, high, local + 1), (low, middle, local + 1)]
    return sorted(done)


def numbered(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The table (row, doc, n_chars, key, pages), in the shared folder: ``columns`` of ``docs`` as one structure
    beside a number for each row."""
    norm = normalised(text_or_empty())
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc")
    rows = docs.select(whole, F.length(text_or_empty()).cast("long").alias("n_chars"), norm.alias("norm"))
    pages = (F.lit(1) + F.expr(f"octet_length(norm) div {PAGE}")).alias("pages")
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc", "n_chars", F.xxhash64("norm").alias("key"), pages), "dedup-rows")


def placed(rows: DataFrame, capacity: int | None = None, depth: int | None = None) -> tuple[DataFrame, int]:
    """A table of :func:`numbered` as row, doc_id, n_chars, norm, key, bucket and overfull, and its number of rows.

    The directory is made from a histogram of at most ``2**depth`` rows, whatever
    the input's size, and is sent to all tasks.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages")).first()
    if depth is None:
        depth = min(MOST_DEPTH, max(1, (total.pages // 64).bit_length()))
    if capacity is None:
        capacity = max(LEAST_CAPACITY, 4 * total.pages >> depth)
    counts = {r.p: r.n for r in rows.groupBy(_prefix(F.col("key"), depth).alias("p")).agg(F.sum("pages").alias("n")).collect()}
    cells = [{"low": low, "high": high, "overfull": sum(counts.get(p, 0) for p in range(low, high + 1)) > capacity} for low, high, _ in directory(counts, depth, capacity)]
    held = F.from_json(F.lit(json.dumps(cells)), "array<struct<low:bigint,high:bigint,overfull:boolean>>")
    buckets = rows.sparkSession.range(1).select(F.posexplode(held).alias("bucket", "cell"))
    # at most 2**depth rows of two numbers
    owner = buckets.select("bucket", "cell.overfull", F.explode(F.sequence("cell.low", "cell.high")).alias("p"))
    out = rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "n_chars", "key", _prefix(F.col("key"), depth).alias("p"))
    out = out.join(F.broadcast(owner), "p")
    return out.select("row", "doc_id", "n_chars", normalised(text_or_empty()).alias("norm"), "key", "bucket", "overfull"), total.n


_RESULT = ["row", "doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket", "chain"]


def _owned(rows: DataFrame) -> DataFrame:
    """Results of the buckets that fit: each is sorted by its owner, where equal bytes in a row make a chain's link."""
    chained = Window.partitionBy("bucket", "key").orderBy("norm")
    copies = Window.partitionBy("bucket", "key", "norm").orderBy(F.col("doc_id").isNull(), F.col("n_chars").desc(), "doc_id", "row")
    whole = copies.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.repartition("bucket").select(
        "row", "doc_id", "bucket", "key", "norm",
        F.first("doc_id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        (F.row_number().over(copies) == 1).alias("kept"),
    )
    out = out.withColumn("chain", F.dense_rank().over(chained)).withColumn("text_sha256", F.sha2("norm", 256))
    return out.select(*_RESULT)


def _combined(rows: DataFrame, total: int) -> DataFrame:
    """Results of overfull buckets: copies are combined before they move, and each row looks its chain up."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), (-F.col("n_chars")).alias("short"), "doc_id", "row"))
    entries = rows.groupBy("bucket", "key", "norm").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    entries = materialise(entries.select("bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "best", "group_size"), "dedup-entries")
    chained = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    entries = entries.withColumn("chain", F.row_number().over(chained))
    own = rows.select("row", "doc_id", "bucket", "key", F.sha2("norm", 256).alias("text_sha256"))
    found = looked_up(own, entries, ["bucket", "key", "text_sha256"], "group_size", total)
    return found.select("row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "bucket", "chain")


def index(rows: DataFrame, capacity: int | None = None, depth: int | None = None) -> DataFrame:
    """The index of a table of :func:`numbered`, in the shared folder: a row for each of its rows: row, doc_id,
    keep_id, group_size, kept, text_sha256, and where it stands: bucket and chain."""
    texts, total = placed(rows, capacity, depth)
    out = _owned(texts.where("NOT overfull")).unionByName(_combined(texts.where("overfull"), total))
    return materialise(out, "dedup-index")


def exact_duplicates(docs: DataFrame, capacity: int | None = None, depth: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays,
    then the smallest doc_id. Null and empty texts form one group, as do all texts
    of white space alone. Of rows that repeat the staying doc_id and its length, one
    is kept. A row without doc_id stays only where its whole group has none; then
    keep_id is null and one such row is kept. Other columns are ignored, whatever
    their names; very long texts count as many pages; an empty table gives an empty
    result.
    """
    rows = numbered(docs, ["doc_id", "text"])
    found = index(rows, capacity, depth)
    release(rows)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame, capacity: int | None = None, depth: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text, as :func:`exact_duplicates` says.

    Columns of any name stay as they are: rows travel as one structure.
    """
    rows = numbered(docs, docs.columns)
    gone = index(rows, capacity, depth).where("NOT kept").select("row")
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, "row", "left_anti").select("doc.*")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
