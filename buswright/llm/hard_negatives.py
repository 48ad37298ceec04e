"""Hard negatives by bit-sliced integer products.

Vectors become integers. A score is an integer inner product, and it is built up
from the bit planes of one side, the most significant first: after each plane a
score lies between what the planes so far give and what the planes to come can
still add, which is between ``(2**b - 1)`` times the sum of the anchor's negative
components and as many times that of its positive ones. Rows whose interval can
no longer qualify are dropped; what is left after the last plane is exact.

A stated set of anchors meets all rows in blocks: a cell is a block of anchors and
a block of rows, both of bounded size, and cells are shuffled. Each cell gives a
few rows for each of its anchors, of which the best are kept by a window whose
first half runs before the shuffle. There are two passes, since the range in
which a negative may lie depends on the positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buswright.llm.common import materialise, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score between which a negative's lies, both included.
LEAST_PERCENT, MOST_PERCENT = 50, 95
#: Rows and anchors of a cell, about: some 4 and 2 MB of vectors of 64 components.
ROW_BLOCK, ANCHOR_BLOCK, FEWEST_ANCHORS = 8192, 4096, 256
#: Blocks of anchors that are made even of few of them, so that all cores have cells.
SPREAD = 8
#: Tasks of a pass at the most; a task takes its cells one after the other.
MOST_TASKS = 20_000
#: Scores that are worked on at a time, and the share of them from which on rows are looked at one by one.
_AT_A_TIME, _FEW = 1 << 20, 1 / 8


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows that take part: key (unlike in all rows), vec_id, label, v (integers floor(scale * x)).

    Rows with a null vec_id, label or vector, or with a component that is null, NaN
    or infinite, take no part. A component whose integer passes 32 bits is an error.
    Other columns are left out, whatever their names.
    """
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    fits = F.forall(x, lambda c: F.abs(c.cast("double") * F.lit(float(scale))) < F.lit(float(1 << 31)))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    valid = vectors.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(F.coalesce(finite, F.lit(False)))
    v = F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for integer products")))
    return materialise(valid.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", v.cast("array<int>").alias("v")), "negatives-vectors")


class _Planes:
    """The bit planes of rows of integers, in two's complement, and a type in which all scores are exact."""

    def __init__(self, x: np.ndarray, anchors: np.ndarray):
        least, most = int(x.min(initial=0)), int(x.max(initial=0))
        self.bits = max(most.bit_length(), (-least - 1).bit_length() if least < 0 else 0)
        bound = max(x.shape[1], 1) * int(np.abs(anchors).max(initial=1)) << (self.bits + 1)
        if bound >= 1 << 63:
            raise OverflowError("integer products of these vectors pass 64 bits")
        self.kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        self.sign = (x < 0).astype(self.kind)
        self.planes = [((x >> b) & 1).astype(self.kind) for b in range(self.bits)]

    def rows(self, at: slice) -> tuple[np.ndarray, list[np.ndarray]]:
        return self.sign[at], [p[at] for p in self.planes]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row; only for rows of k values at least."""
    return np.partition(values, values.shape[-1] - k, axis=-1)[..., values.shape[-1] - k]


def _candidates(a: np.ndarray, sign: np.ndarray, planes: list[np.ndarray], allowed: np.ndarray, least: np.ndarray, most: np.ndarray, k: int | None):
    """Work through planes for a block of anchors and all rows of a block until few rows can still qualify.

    ``least`` and ``most`` bound each anchor's scores; with ``k`` a score must also
    reach the k-th largest that is certain, of rows ``allowed``. Gives the scores so
    far, the rows left and the number of planes left.
    """
    negative, positive = np.minimum(a, 0).sum(1), np.maximum(a, 0).sum(1)
    scores = (a @ sign.T) * -(1 << len(planes))
    alive, b = allowed, len(planes)
    while b and np.count_nonzero(alive) > alive.size * _FEW:
        b -= 1
        scores += (a @ planes[b].T) * (1 << b)
        rest = (1 << b) - 1
        alive = allowed & (scores >= (least - rest * positive)[:, None]) & (scores <= (most - rest * negative)[:, None])
        if k is not None and scores.shape[1] > k:
            # one of the rows may be the anchor itself, which doesn't count
            certain = _kth(scores, k + 1) + rest * negative
            alive &= scores >= (certain - rest * positive)[:, None]
    return scores, alive, b


def _finish(a: np.ndarray, scores: np.ndarray, rows: np.ndarray, planes: list[np.ndarray], b: int, windows: list[tuple[int, int]], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The best ``k`` rows of one anchor in each window, as (window, rows, scores); earlier rows win ties."""
    negative, positive = np.minimum(a, 0).sum(), np.maximum(a, 0).sum()
    while b and len(rows):
        b -= 1
        scores = scores + (planes[b][rows] @ a) * (1 << b)
        rest = (1 << b) - 1
        low, high = scores + rest * negative, scores + rest * positive
        keep = np.zeros(len(rows), bool)
        for least, most in set(windows):
            inside = (high >= least) & (low <= most)
            sure = low[(low >= least) & (high <= most)]
            if len(sure) >= k:
                inside &= high >= _kth(sure, k)
            keep |= inside
        rows, scores = rows[keep], scores[keep]
    out = []
    for w, (least, most) in enumerate(windows):
        inside = np.flatnonzero((scores >= least) & (scores <= most))
        best = inside[np.argsort(-scores[inside], kind="stable")[:k]]
        if len(best):
            out.append((w, rows[best], scores[best]))
    return out


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    lists = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], pa.list_(pa.int32()))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _widest(*sides: pa.ChunkedArray) -> int:
    return max(int(pc.max(pc.list_value_length(side)).as_py() or 0) for side in sides)


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Labels of any type as numbers that are equal where labels are."""
    both = pa.chunked_array([c for column in columns for c in column.chunks]).combine_chunks()
    both = pa.concat_arrays(both.chunks) if isinstance(both, pa.ChunkedArray) else both
    codes = both.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _numbers(t: pa.Table, column: str) -> np.ndarray:
    return t[column].to_numpy().astype(np.int64)


def _positives_of(rows: pa.Table, anchors: pa.Table, k: int):
    """(place of the anchor, places of its best rows of the same label, scores) of a cell."""
    width = _widest(rows["v"], anchors["a_v"])
    x, a = _matrix(rows["v"], width), _matrix(anchors["a_v"], width)
    ours, theirs = _codes(rows["label"], anchors["a_label"])
    ids, keys, own = _numbers(rows, "vec_id"), _numbers(rows, "key"), _numbers(anchors, "a_key")
    order = np.lexsort((ids, ours))
    ours, keys, slices = ours[order], keys[order], _Planes(x[order], a)
    a = a.astype(slices.kind)
    for label in np.unique(theirs):
        first, last = np.searchsorted(ours, [label, label + 1])
        mine = np.flatnonzero(theirs == label)
        sign, planes = slices.rows(slice(first, last))
        step = max(1, _AT_A_TIME // max(last - first, 1))
        for start in range(0, len(mine) if last > first else 0, step):
            some = mine[start : start + step]
            every = np.full(len(some), np.iinfo(np.int64).max // 2, np.float64 if slices.kind != np.int64 else np.int64)
            scores, alive, b = _candidates(a[some], sign, planes, keys[None, first:last] != own[some, None], -every, every, k)
            for i, anchor in enumerate(some):
                left = np.flatnonzero(alive[i])
                for _, best, score in _finish(a[anchor], scores[i, left], left, planes, b, [(-float("inf"), float("inf"))], k):
                    yield anchor, order[first + best], score


def _negatives_of(rows: pa.Table, anchors: pa.Table, k: int, percent: tuple[int, int]):
    """(place of the anchor, slot, places of its best rows of other labels in the slot's range, scores) of a cell."""
    width = _widest(rows["v"], anchors["a_v"])
    order = np.argsort(_numbers(rows, "vec_id"), kind="stable")
    x, a = _matrix(rows["v"], width)[order], _matrix(anchors["a_v"], width)
    ours, theirs = _codes(rows["label"], anchors["a_label"])
    ours, slices = ours[order], _Planes(x, a)
    a = a.astype(slices.kind)
    found = [[(-(-percent[0] * p["score"] // 100), percent[1] * p["score"] // 100) for p in ps] for ps in anchors["a_positives"].to_pylist()]
    least = np.array([min(w[0] for w in ws) for ws in found], np.int64)
    most = np.array([max(w[1] for w in ws) for ws in found], np.int64)
    sign, planes = slices.rows(slice(None))
    step = max(1, _AT_A_TIME // max(len(x), 1))
    for start in range(0, len(a), step):
        some = slice(start, start + step)
        scores, alive, b = _candidates(a[some], sign, planes, ours[None, :] != theirs[some, None], least[some], most[some], None)
        for i, anchor in enumerate(range(start, min(start + step, len(a)))):
            left = np.flatnonzero(alive[i])
            for slot, best, score in _finish(a[anchor], scores[i, left], left, planes, b, found[anchor], k):
                yield anchor, slot, order[best], score


def _cells(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int):
    """Both sides by cell, to be taken together."""
    blocks = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    block = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n))
    cell = lambda a, r: (a * F.lit(row_blocks) + r).alias("cell")
    left = rows.withColumn("__r", block(row_blocks, 1)).withColumn("__a", F.explode(blocks(anchor_blocks))).select(cell(F.col("__a"), F.col("__r")), "key", "vec_id", "label", "v")
    right = anchors.withColumn("__a", block(anchor_blocks, 2)).withColumn("__r", F.explode(blocks(row_blocks)))
    # columns of their own on either side, though both come from one table
    right = right.select(cell(F.col("__a"), F.col("__r")), *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    tasks = min(2 * row_blocks * anchor_blocks, MOST_TASKS)
    return left.repartition(tasks, "cell").groupBy("cell").cogroup(right.repartition(tasks, "cell").groupBy("cell"))


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: tuple[int, int] = (LEAST_PERCENT, MOST_PERCENT), scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and embedding; ``anchor`` is a condition on the
    names vec_id and label that says which rows are anchors. An anchor's positives are its best
    ``positives`` other rows of the same label by inner product, ties by smaller
    vec_id; for each of them the best ``negatives`` rows of other labels come out
    whose score lies between the two percentages of the positive's.

    Rows that repeat a vec_id are rows of their own, as positives of each other too;
    vectors of unlike lengths are filled up with zeros. Which rows take no part, and
    which are an error, is in :func:`prepared`. A positive of a negative score has no
    negatives, since its range is empty. An empty table gives an empty result.
    """
    rows = prepared(vectors, scale)
    chosen = rows.where(anchor)
    n, m = rows.count(), chosen.count()
    row_blocks = max(1, -(-n // ROW_BLOCK))
    anchor_blocks = max(1, -(-m // ANCHOR_BLOCK), min(SPREAD, -(-m // FEWEST_ANCHORS)))

    first_schema = "anchor long, anchor_id long, vec_id long, score long"

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.full(len(best), place), best, score) for place, best, score in (_positives_of(left, right, positives) if left.num_rows and right.num_rows else ())]
        places, bests, scores = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"anchor": _numbers(right, "a_key")[places], "anchor_id": _numbers(right, "a_vec_id")[places], "vec_id": _numbers(left, "vec_id")[bests], "score": scores})

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    found = _cells(rows, chosen, row_blocks, anchor_blocks).applyInArrow(first, first_schema).withColumn("slot", F.row_number().over(best)).where(F.col("slot") <= positives)
    found = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "vec_id", "score"))).alias("positives"))
    paired = materialise(chosen.join(found, chosen["key"] == found["anchor"]).drop("anchor"), "negatives-positives")

    second_schema = "anchor long, slot int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({c: pa.array([], pa.int32() if c == "slot" else pa.int64()) for c in names})
        ours, keys, ids, held = _numbers(left, "vec_id"), _numbers(right, "a_key"), _numbers(right, "a_vec_id"), right["a_positives"].to_pylist()
        out: dict[str, list] = {c: [] for c in names}
        for place, slot, best, score in _negatives_of(left, right, negatives, percent):
            p = held[place][slot]
            for c, value in zip(names, (keys[place], slot, ids[place], p["vec_id"], p["score"]), strict=False):
                out[c] += [int(value)] * len(best)
            out["negative_id"] += ours[best].tolist()
            out["negative_score"] += score.astype(np.int64).tolist()
        return pa.table({c: pa.array(v, pa.int32() if c == "slot" else pa.int64()) for c, v in out.items()})

    names = ["anchor", "slot", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    out = _cells(rows, paired, row_blocks, anchor_blocks).applyInArrow(second, second_schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_bit_sliced_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


OP11_SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
