"""A content-addressed store of token ids.

Documents are encoded, each ended by an end id, and written in ascending doc_id
order. A rolling hash over the last ``WINDOW`` ids cuts each document's ids into
chunks where its low bits are zero, so equal passages of different documents
give equal chunks wherever they stand. A store is a folder of three tables:

* ``chunks``: chunk_id (SHA-256 of the body), n ids, body; each distinct chunk once.
  The body holds the ids as little-endian unsigned 16-bit integers, 32-bit where
  the vocabulary needs it;
* ``recipes``: part, doc_id, n_tokens, chunk ids in order; parts are ranges of
  doc_id and each is sorted by it;
* ``manifest``: part, first position, documents, tokens and the Merkle root over
  the part's recipes. The store's root is the Merkle root over the parts' roots.

Reading checks every chunk body against its address and every recipe against
the manifest.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buswright.llm.common import looked_up, lower_ascii, materialise, mixed, release, row_starts, scratch, slices, table, utf8, word_bounds
from buswright.llm.wordcache import WordCache

END_ID = 1
WINDOW, MASK = 16, 511
SHORTEST, LONGEST = 128, 4096
#: Documents of a part, about, where there are more of them than shuffle partitions take, and its chunks, about, in smaller stores.
PART_ROWS, PART_CHUNKS = 500_000, 20_000
#: The preparation of text that encoding by words relies on; a tokenizer with another one gets whole texts.
_PREPARED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
}
#: Letters that normalisation leaves alone.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Signs that the tokenizer cuts off a word's end, and the same as a table of all bytes.
_STOPS = b".,;:!?"
_STOP = np.isin(np.arange(256), list(_STOPS))
RECIPE = "doc_id long, n_tokens long, chunk_ids array<binary>, sizes array<int>"


def tokenizer_content(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def cut(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """The ends of the chunks of each document's ids; ``bounds`` are the documents' bounds in ``ids``."""
    if not len(ids):
        return [[] for _ in bounds[1:]]
    sums = np.cumsum(mixed(np.arange(int(ids.max()) + 1))[ids], dtype=np.uint64)
    # the window ends at the document's beginning
    back = np.maximum(np.arange(len(ids)) - WINDOW, np.repeat(bounds[:-1], np.diff(bounds)) - 1)
    rolling = sums - np.where(back >= 0, sums[back], np.uint64(0))
    marks = (np.flatnonzero(mixed(rolling) & np.uint64(MASK) == 0) + 1).tolist()
    out = []
    for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends, at = [], start
        while at < stop:
            k = bisect.bisect_left(marks, at + SHORTEST)
            at = min(marks[k] if k < len(marks) else stop, at + LONGEST, stop)
            ends.append(at - start)
        out.append(ends)
    return out


class _Encoder:
    """Encodes whole texts by their distinct words, which ASCII white space parts.

    The tokenizer drops white space and matches nothing across it.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, read = Tokenizer.from_str(content), json.loads(content)
        self.by_words = all(read.get(k) == v for k, v in _PREPARED.items()) and all(t["content"].startswith("<|") for t in read.get("added_tokens", []))
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 else np.dtype("<u4")
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: alphabet.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.cache = WordCache(self._words)

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row and how many each has.

        A word of lower-case Latin letters is the same after the tokenizer's
        normalisation and one piece for its model, to which it goes in the model's
        alphabet for bytes. All others go through the whole tokenizer.
        """
        found: list[list[int]] = []
        others: list[tuple[int, str]] = []
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for word in words:
            text = word.decode("utf-8", "replace")
            if _LETTERS.fullmatch(text):
                found.append([t.id for t in tokenize(text if text.isascii() else text.translate(letters))])
            else:
                others.append((len(found), text))
                found.append([])
        for (i, _), e in zip(others, self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return np.array([i for f in found for i in f], np.int32), np.array([len(f) for f in found], np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_words:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(["" if t is None else t for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.int32), np.r_[0, np.cumsum([len(ids) for ids in found])].astype(np.int64)
        data, bounds = utf8(texts)
        starts, ends, _ = word_bounds(data, bounds)
        if not ((data[:-1] == 60) & (data[1:] == 124)).any():
            # the tokenizer lowers case itself; only its special strings <|...|> mind
            data = lower_ascii(data)
        starts, ends = without_stops(data, starts, ends)
        rows = np.searchsorted(bounds, starts, side="right") - 1
        ids, counts = self.cache(data, starts, ends)
        return ids, np.r_[0, np.cumsum(counts)][row_starts(rows, len(texts))]


def without_stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words cut before the ``.,;:!?`` at their end where these follow a letter or digit.

    The tokenizer cuts there too, and there are far fewer distinct words without them.
    """
    if not len(starts):
        return starts, ends
    some = np.flatnonzero(_STOP[data[ends - 1]])
    stem, left = ends[some], np.arange(len(some))
    # back from the end of such words only, all at once; the few with many stops one by one
    for _ in range(8):
        stem[left] -= 1
        left = left[stem[left] > starts[some[left]]]
        left = left[_STOP[data[stem[left] - 1]]]
    for i in left.tolist():
        stem[i] = starts[some[i]] + len(data[starts[some[i]] : stem[i]].tobytes().rstrip(_STOPS))
    some, stem = some[stem > starts[some]], stem[stem > starts[some]]
    last, before = data[stem - 1], data[np.maximum(stem - 2, 0)]
    plain = ((last | 32 >= 97) & (last | 32 <= 122)) | ((last >= 48) & (last <= 57))
    # U+00C0 to U+00FF but for the signs of multiplication and division
    latin = (before == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7) & (stem - 2 >= starts[some])
    some, stem = some[plain | latin], stem[plain | latin]
    more = ends[some]
    ends = ends.copy()
    ends[some] = stem
    starts, ends = np.concatenate([starts, stem]), np.concatenate([ends, more])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, chunk_ids, sizes, bodies: a row a document."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _Encoder(held.value)
        for part in slices(batches):
            ids, bounds = encoder(part.column("text"))
            ids = np.insert(ids, bounds[1:], END_ID)
            bounds = bounds + np.arange(len(bounds))
            raw, width = ids.astype(encoder.dtype).tobytes(), encoder.dtype.itemsize
            tokens, keys, sizes, bodies = np.diff(bounds), [], [], []
            for a, ends in zip(bounds[:-1].tolist(), cut(ids, bounds), strict=True):
                own = [raw[(a + s) * width : (a + e) * width] for s, e in zip([0, *ends], ends, strict=False)]
                bodies.append(own)
                keys.append([hashlib.sha256(x).digest() for x in own])
                sizes.append([e - s for s, e in zip([0, *ends], ends, strict=False)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array(bodies, pa.list_(pa.binary()))],
                names=["doc_id", "n_tokens", "chunk_ids", "sizes", "bodies"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, RECIPE + ", bodies array<binary>")


class Merkle:
    """The root over a stream of leaves, with memory for one node a level."""

    def __init__(self):
        self.levels: list[bytes | None] = []
        self.count = 0

    def add(self, leaf: bytes) -> None:
        node, self.count = hashlib.sha256(b"\0" + leaf).digest(), self.count + 1
        for k, held in enumerate(self.levels):
            if held is None:
                self.levels[k] = node
                return
            node, self.levels[k] = hashlib.sha256(b"\1" + held + node).digest(), None
        self.levels.append(node)

    def root(self) -> bytes:
        node = b""
        for held in self.levels:
            if held is not None:
                node = hashlib.sha256(b"\1" + held + node).digest() if node else held
        return node or hashlib.sha256(b"").digest()


def _roots(recipes: DataFrame) -> DataFrame:
    """part, documents, tokens and root of each part; a part's rows come sorted, by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, list] = {}
        for batch in batches:
            for part, doc_id, n, keys in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tree = trees.setdefault(part, [Merkle(), 0])
                tree[0].add(f"{doc_id} {n} ".encode() + b"".join(keys))
                tree[1] += n
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(trees, pa.int32()), "documents": pa.array([t.count for t, _ in trees.values()], pa.int64()), "tokens": pa.array([n for _, n in trees.values()], pa.int64()), "root": pa.array([t.root() for t, _ in trees.values()], pa.binary())}
        )

    return recipes.select("part", "doc_id", "n_tokens", "chunk_ids").mapInArrow(run, "part int, documents long, tokens long, root binary")


def _ordered(recipes: DataFrame) -> DataFrame:
    """Each part whole in one task and sorted, as the Merkle trees need it."""
    return recipes.repartition("part").sortWithinPartitions("part", "doc_id", "n_tokens", "chunk_ids")


def write_store(docs: DataFrame, path: str, tokenizer: str) -> str:
    """Encode ``docs`` (doc_id, text) into a store at ``path`` and return the store's root in hex.

    Very long texts are cut into as many chunks as they need. Other columns are
    left out, whatever their names. ``path`` gets the three tables alone.

    Null and empty texts hold the end id alone. Rows that repeat a doc_id are
    documents of their own, in the order of their lengths and chunk ids; a null
    doc_id comes first. An empty table makes an empty store. Only the manifest,
    one row a part, comes to the driver.
    """
    spark = docs.sparkSession
    # every document's chunks with their bodies: gone as soon as chunks and recipes are written
    encoded = materialise(_encoded(docs, tokenizer), "token-bodies", "zstd")
    chunks = encoded.select(F.explode(F.arrays_zip("chunk_ids", "sizes", "bodies")).alias("c")).select("c.chunk_ids", "c.sizes", "c.bodies").toDF("chunk_id", "n", "body")
    # copies are combined in each task before the shuffle
    chunks.distinct().write.option("compression", "zstd").parquet(f"{path}/chunks")
    total = encoded.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("sizes")), F.lit(0)).alias("chunks")).first()
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total.chunks // PART_CHUNKS), total.rows // PART_ROWS)
    # rows that repeat a doc_id are parted too: by size, first chunk and, where that is all, by chance, since equal rows have no order
    order = ["doc_id", "n_tokens", "chunk_ids"]
    recipes = encoded.drop("bodies").withColumn("first", F.col("chunk_ids")[0]).withColumn("chance", F.when(F.size("chunk_ids") > 1, F.lit(2.0)).otherwise(F.rand(5)))
    recipes = recipes.repartitionByRange(parts, "doc_id", "n_tokens", "first", "chance").sortWithinPartitions(*order)
    recipes.select(F.spark_partition_id().alias("part"), *order, "sizes").write.parquet(f"{path}/recipes")
    release(encoded)
    rows = sorted(_roots(_ordered(spark.read.parquet(f"{path}/recipes"))).collect())
    top, first, manifest = Merkle(), 0, []
    for part, documents, tokens, root in rows:
        top.add(bytes(root))
        manifest.append((part, first, documents, tokens, bytes(root)))
        first += tokens
    spark.createDataFrame(manifest, "part int, first long, documents long, tokens long, root binary").coalesce(1).write.parquet(f"{path}/manifest")
    return top.root().hex()


def verify_store(spark: SparkSession, path: str, root: str, bodies: bool = True) -> None:
    """Raise StoreError unless recipes and manifest agree with ``root``, and chunk bodies with their addresses."""
    held = sorted(spark.read.parquet(f"{path}/manifest").collect())
    top = Merkle()
    for row in held:
        top.add(bytes(row.root))
    found = {r.part: (r.documents, r.tokens, bytes(r.root)) for r in _roots(_ordered(spark.read.parquet(f"{path}/recipes"))).collect()}
    if top.root().hex() != root or found != {r.part: (r.documents, r.tokens, bytes(r.root)) for r in held}:
        raise StoreError(f"the recipes in {path} don't match their manifest")
    if not bodies:
        return
    bad = spark.read.parquet(f"{path}/chunks").where(F.unhex(F.sha2("body", 256)) != F.col("chunk_id"))
    if bad.limit(1).count():
        raise StoreError(f"a chunk in {path} doesn't match its address")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with start, the ids of all documents before each: a running sum within each range of doc_id."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    before = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "chunk_ids").rowsBetween(Window.unboundedPreceding, -1)
    inside = recipes.withColumn("__inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # the manifest has one row a part
    return inside.join(F.broadcast(manifest.select("part", "first")), "part").withColumn("start", F.col("first") + F.col("__inside")).drop("__inside", "first")


class StoreError(ValueError):
    """A store whose files don't give back what was written."""


def _raise_missing(found: str) -> Column:
    """``found``, or an error where a recipe's chunk is not among the chunks."""
    say = F.concat(F.lit("chunk "), F.lower(F.hex("chunk_id")), F.lit(" of a recipe is missing from the store"))
    return F.when(F.col(found).isNotNull(), F.col(found)).otherwise(F.raise_error(say))


def _with_chunks(steps: DataFrame, chunks: DataFrame) -> DataFrame:
    """``steps`` with n and the last column of ``chunks`` (chunk_id, n, ...); an error for a step without its chunk."""
    n, held = chunks.columns[1:]
    uses = steps.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("uses"))
    found = uses.join(chunks, "chunk_id", "left").withColumn(n, _raise_missing(n)).select("chunk_id", "uses", n, held)
    # the chunk of all empty texts may be in a third of all recipes
    return looked_up(steps, materialise(found, "store-chunks"), ["chunk_id"], "uses", steps.count())


def _steps(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "start", "n_tokens", F.posexplode(F.arrays_zip("chunk_ids", "sizes")).alias("seq", "c")).select("doc_id", "start", "n_tokens", "seq", F.col("c.chunk_ids").alias("chunk_id"))


def _check_sizes(batch: pa.RecordBatch, found: np.ndarray) -> None:
    bad = np.flatnonzero(found != batch.column(2).to_numpy())
    if len(bad):
        i = int(bad[0])
        raise StoreError(f"document {batch.column(0)[i]} has {found[i]} ids, not the {batch.column(2)[i]} of its recipe")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store: doc_id, start, n_tokens, ids; the end id is the last of the ids.

    Raises where a chunk is missing or a document's chunks hold another number of ids than its recipe says.
    """
    bodies = spark.read.parquet(f"{path}/chunks").select("chunk_id", "n", "body")
    steps = _with_chunks(_steps(_placed(spark, path)), bodies)
    whole = steps.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "body"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(p["body"], "<u2" if len(p["body"]) == 2 * p["n"] else "<u4") for p in parts]).tolist() for parts in batch.column(3).to_pylist()]
            _check_sizes(batch, np.array([len(i) for i in ids], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "n_tokens", "ids"])

    return whole.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<long>")


def _power_tables(count: int = 40) -> np.ndarray:
    """For k: what 2**k zero bytes do to a crc32, as four tables of a byte each."""
    one = np.zeros(32, np.uint32)
    one[0] = 0xEDB88320
    one[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)

    def times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
        bits = (x[..., None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        return np.bitwise_xor.reduce(np.where(bits == 1, matrix, np.uint32(0)), axis=-1)

    matrix = one
    for _ in range(3):
        matrix = times(matrix, matrix)
    out = np.zeros((count, 4, 256), np.uint32)
    for k in range(count):
        for b in range(4):
            out[k, b] = times(matrix, np.arange(256, dtype=np.uint32) << np.uint32(8 * b))
        matrix = times(matrix, matrix)
    return out


def crc_joined(first: np.ndarray, second: np.ndarray, length: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """crc32 of each A + B from crc32(A), crc32(B) and the bytes in B."""
    crc, left, k = first.astype(np.uint32), length.astype(np.int64), 0
    while left.any():
        shifted = tables[k, 0][crc & 255] ^ tables[k, 1][(crc >> 8) & 255] ^ tables[k, 2][(crc >> 16) & 255] ^ tables[k, 3][crc >> 24]
        crc = np.where(left & 1 == 1, shifted, crc)
        left, k = left >> 1, k + 1
    return crc ^ second.astype(np.uint32)


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a store's documents, from its files.

    ids_crc32 is the unsigned crc32 of the document's ids as little-endian unsigned
    32-bit integers. Each chunk body is read, checked against its address and
    summed once; the sums, not the bodies, travel to the documents that use the
    chunk, where they are joined to that of the whole. Raises where a chunk is
    missing or a document's chunks hold another number of ids than its recipe says.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for key, n, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if hashlib.sha256(body).digest() != key:
                    raise StoreError(f"chunk {key.hex()} doesn't match its address")
                sums.append(zlib.crc32(np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["chunk_id", "n", "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _power_tables()
        for batch in batches:
            lists = batch.column(3)
            counts = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            n, crc = (np.asarray(flat.field(i)) for i in (1, 2))
            at = np.cumsum(counts) - counts
            _check_sizes(batch, np.add.reduceat(n, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64))
            total = np.zeros(len(counts), np.uint32)
            for k in range(int(counts.max(initial=0))):
                rows = np.flatnonzero(counts > k)
                total[rows] = crc_joined(total[rows], crc[at[rows] + k], 4 * n[at[rows] + k], tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(total.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    sums = spark.read.parquet(f"{path}/chunks").mapInArrow(summed, "chunk_id binary, n int, crc long")
    steps = _with_chunks(_steps(_placed(spark, path)), sums)
    whole = steps.groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "crc"))).alias("parts"))
    return whole.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_store(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    root = write_store(table(spark, sf_dir, "documents"), path, tokenizer_content())
    # the digests check each body that they read
    verify_store(spark, path, root, bodies=False)
    return document_digests(spark, path)
