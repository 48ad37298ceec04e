"""Toxic spans by a linear-chain conditional random field.

Each word of a text is tagged as toxic or not. What a word looks like (the word
without case and outer punctuation, and its first bytes) weighs on its own tag,
and neighbouring tags weigh on each other. Forward-backward gives each word's
marginal probability of being toxic; a document's score is a calibrated function
of its marginals and its offending spans are the runs of words above a half.

Documents are labelled, not words. The words to learn from are labelled by
comparing documents: in a toxic document, a word or beginning of a word that
toxic documents use far more often than others is a toxic token.

With two tags a forward step maps the ratio of the two forward weights by a
2x2 matrix, so the chains of a whole batch run at once: matrices are multiplied
up within blocks of words, over the blocks, and back into them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buswright.llm.common import fold, logistic, lower_ascii, materialise, row_starts, sampled, slices, table, utf8, without, word_bounds, word_hashes
from buswright.llm.mixing import word_count

#: Labelled documents to learn from, about, of either label, and the words that all of a label may have.
TOXIC_SAMPLE, CLEAN_SAMPLE = 600, 2400
TOXIC_WORDS, CLEAN_WORDS = 400_000, 1_000_000
#: Every so many documents of the sample one is kept aside, on which scores are calibrated.
ASIDE = 4
#: How unlikely, as a negative logarithm, it must be that toxic documents alone have a feature by chance.
EVIDENCE = 12.0
#: Buckets of the hashed features of a word.
BUCKETS = 1 << 18
#: Bytes of a word that its prefix features take.
PREFIXES = (4, 5, 6)
_BLOCK = 64
#: Words that are worked on at a time, in one text or many.
_WORDS = 1 << 17
FOLDS, HELD_OUT = 5, 0


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at either end, as far as something else is left."""
    plain = np.ones(256, bool)
    plain[33:48] = plain[58:65] = plain[91:97] = plain[123:127] = False
    first, last = starts.copy(), ends.copy()
    open_ = np.flatnonzero(~plain[data[first]])
    while len(open_):
        first[open_] += 1
        open_ = open_[first[open_] < last[open_]]
        open_ = open_[~plain[data[first[open_]]]]
    bare = first == last
    first[bare] = starts[bare]
    open_ = np.flatnonzero(~bare & ~plain[data[last - 1]])
    while len(open_):
        last[open_] -= 1
        open_ = open_[~plain[data[last[open_] - 1]]]
    return first, last


def word_features(low: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Features (n, k) of words of lower-cased bytes."""
    columns = [word_hashes(low, first, last)]
    columns += [word_hashes(low, first, np.minimum(last, first + k)) + np.uint64(k) for k in PREFIXES]
    return np.stack([(c % np.uint64(BUCKETS)).astype(np.int32) for c in columns], axis=1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, starts and ends of their trimmed words, the rows' bounds in these."""
    data, bounds = utf8(texts)
    starts, ends, rows = word_bounds(data, bounds)
    low = lower_ascii(data)
    first, last = _trimmed(low, starts, ends)
    return low, first, last, row_starts(rows, len(texts))


def _ratios(m: np.ndarray, r: float = 0.0) -> np.ndarray:
    """Forward ratios of a chain of steps: r[t] = (m[2,t] + m[3,t] r[t-1]) / (m[0,t] + m[1,t] r[t-1]), from ``r``."""
    n = m.shape[1]
    if n <= 4 * _BLOCK:
        out = np.empty(n)
        for t, (a, b, c, d) in enumerate(m.T.tolist()):
            r = (c + d * r) / (a + b * r)
            out[t] = r
        return out
    blocks = -(-n // _BLOCK)
    padded = np.zeros((4, blocks * _BLOCK))
    padded[[0, 3]] = 1.0
    padded[:, :n] = m
    padded = np.ascontiguousarray(padded.reshape(4, blocks, _BLOCK).transpose(2, 0, 1))
    a, b, c, d = padded[0]
    for step in padded[1:]:
        p, q, s, t = step
        a, b, c, d = p * a + q * c, p * b + q * d, s * a + t * c, s * b + t * d
        scale = 1.0 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    carried = np.r_[r, _ratios(np.stack([a, b, c, d]), r)[:-1]]
    out = np.empty((_BLOCK, blocks))
    for k, (p, q, s, t) in enumerate(padded):
        carried = (s + t * carried) / (p + q * carried)
        out[k] = carried
    return out.T.reshape(-1)[:n]


def _chain(scores: np.ndarray, bounds: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward ratios of each word, a stretch of words at a time, and where texts begin."""
    n, w = len(scores), np.exp(transition)
    begins = np.zeros(n, bool)
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    alpha, beta = np.empty(n), np.empty(n)
    for low in range(0, n, _WORDS):
        e, new = np.exp(np.clip(scores[low : low + _WORDS], -30, 30)), begins[low : low + _WORDS]
        m = np.stack([np.full(len(e), w[0, 0]), np.full(len(e), w[1, 0]), w[0, 1] * e, w[1, 1] * e])
        m[:, new] = np.stack([np.ones(len(e)), np.zeros(len(e)), e, np.zeros(len(e))])[:, new]
        alpha[low : low + _WORDS] = _ratios(m, alpha[low - 1] if low else 0.0)
    # the ratio of what follows tag 1 to what follows tag 0: (w10 + w11 e r) / (w00 + w01 e r) of the next word's
    for low in reversed(range(0, n, _WORDS)):
        high = min(low + _WORDS, n)
        e = np.exp(np.clip(np.r_[scores[low + 1 : high + 1], 0.0][: high - low], -30, 30))
        m = np.stack([np.full(len(e), w[0, 0]), w[0, 1] * e, np.full(len(e), w[1, 0]), w[1, 1] * e])
        m[:, np.r_[begins[low + 1 : high + 1], True][: high - low]] = np.array([[1.0], [0.0], [1.0], [0.0]])
        beta[low:high] = _ratios(m[:, ::-1], beta[high] if high < n else 0.0)[::-1]
    return alpha, beta, begins


def probabilities(scores: np.ndarray, bounds: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Each word's probability of being toxic.

    ``scores`` are the words' weights for the toxic tag, ``transition[i, j]`` the
    weight of tag j after tag i. A text's first word has no word before it.
    """
    if not len(scores):
        return np.zeros(0)
    alpha, beta, _ = _chain(scores, bounds, transition)
    alpha *= beta
    return alpha / (1.0 + alpha)


def marginals(scores: np.ndarray, bounds: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`probabilities`, and for each word the probabilities of its tag with that of the word before it."""
    if not len(scores):
        return np.zeros(0), np.zeros((0, 4))
    alpha, beta, begins = _chain(scores, bounds, transition)
    e, w, both = np.exp(np.clip(scores, -30, 30)), np.exp(transition), alpha * beta
    before = np.r_[0.0, alpha[:-1]]
    joint = np.stack([np.full(len(e), w[0, 0]), w[0, 1] * e * beta, w[1, 0] * before, w[1, 1] * before * e * beta], axis=1)
    joint /= joint.sum(axis=1, keepdims=True)
    joint[begins] = 0.0
    return both / (1.0 + both), joint


def token_labels(found: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words of the toxic documents are toxic tokens.

    They have a feature that is all but absent from other documents and that more
    toxic documents have than chance explains: of k documents drawn at random, all
    would be toxic with the k-th power of the share of toxic ones. Toxic documents
    that are left without a toxic token are looked at again by themselves, where
    fewer documents are telling, until that finds nothing more.
    """
    docs = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    seen = []
    for k in range(found.shape[1]):
        both = np.sort(docs * BUCKETS + found[:, k])
        both = both[np.r_[True, both[1:] != both[:-1]]]
        seen.append(((both // BUCKETS).astype(np.int32), (both % BUCKETS).astype(np.int32)))
    others = [np.bincount(bucket[~toxic[doc]], minlength=BUCKETS) for doc, bucket in seen]
    label, open_ = np.zeros(len(found), bool), toxic.copy()
    while open_.any():
        surprise = -np.log((open_.sum() + 0.5) / (len(toxic) + 1))
        new = np.zeros(len(found), bool)
        for k, (doc, bucket) in enumerate(seen):
            mine = np.bincount(bucket[open_[doc]], minlength=BUCKETS)
            new |= ((mine * surprise >= EVIDENCE) & (others[k] <= mine / 20))[found[:, k]]
        label |= new & toxic[docs]
        left = open_ & ~(np.bincount(docs[label], minlength=len(toxic)) > 0)
        if left.sum() == open_.sum():
            break
        open_ = left
    return label


@dataclass
class Tagger:
    weights: np.ndarray
    transition: np.ndarray
    bias: float
    link: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        return self.weights[found].sum(axis=1) + self.bias

    def marginals(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return probabilities(self.scores(found), bounds, self.transition)

    def tag(self, low: np.ndarray, first: np.ndarray, last: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each word's probability of being toxic; features are made and forgotten a stretch of words at a time."""
        scores = np.empty(len(first))
        for at in range(0, len(first), _WORDS):
            scores[at : at + _WORDS] = self.scores(word_features(low, first[at : at + _WORDS], last[at : at + _WORDS]))
        return probabilities(scores, bounds, self.transition)

    def documents(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return logistic(summary(p, bounds) @ self.link)


def summary(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What a document's score is made of: 1, its largest marginal and the log of their sum."""
    total, top = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
    some = np.diff(bounds) > 0
    if some.any():
        total[some] = np.add.reduceat(p, bounds[:-1][some])
        top[some] = np.maximum.reduceat(p, bounds[:-1][some])
    return np.stack([np.ones(len(total)), top, np.log1p(total)], axis=1)


def _stretches(bounds: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of documents of about ``_WORDS`` words, or of one document of more."""
    out, low = [], 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + _WORDS, side="right")) - 1)
        out.append((low, high))
        low = high
    return out


def fit(found: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, rounds: int = 60) -> Tagger:
    """A tagger from words' features, the documents' bounds in them and the documents' labels.

    Documents are worked on a stretch at a time, so little memory is needed beside ``found``.
    """
    if not toxic.any() or not len(found):
        return Tagger(np.zeros(BUCKETS), np.zeros((2, 2)), -30.0, np.array([-6.0, 6.0, 0.0]))
    # of each label some are kept aside to calibrate on, as soon as there are many
    rank = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)) - 1
    aside = (rank % ASIDE == ASIDE - 1) & (toxic.sum() >= 20)
    size = np.diff(bounds)
    learnt = np.flatnonzero(~aside)
    own = np.concatenate([found[a:b] for a, b in zip(bounds[learnt].tolist(), bounds[learnt + 1].tolist(), strict=True)])
    label = token_labels(own, np.r_[0, np.cumsum(size[learnt])], toxic[learnt])
    starts = np.zeros(len(bounds), np.int64)
    starts[learnt] = np.cumsum(size[learnt]) - size[learnt]
    del own
    # as many clean documents as toxic ones make the chains; all of them made the token labels
    chains = np.flatnonzero(~aside & (toxic | (np.cumsum(~toxic & ~aside) <= toxic[~aside].sum())))
    parts = []
    for low, high in _stretches(np.r_[0, np.cumsum(size[chains])]):
        docs = chains[low:high]
        x = np.concatenate([found[bounds[d] : bounds[d + 1]] for d in docs.tolist()])
        y = np.concatenate([label[starts[d] : starts[d] + size[d]] for d in docs.tolist()])
        parts.append((x, y.astype(np.float32), np.r_[0, np.cumsum(size[docs])].astype(np.int64)))
    pairs, positive, total = np.zeros(4), 0.0, 0
    for _, y, at in parts:
        after = np.ones(len(y), bool)
        after[at[:-1][np.diff(at) > 0]] = False
        now, before = y[after], y[np.flatnonzero(after) - 1]
        pairs += [float(x) for x in (((1 - before) * (1 - now)).sum(), ((1 - before) * now).sum(), (before * (1 - now)).sum(), (before * now).sum())]
        positive, total = positive + float(y.sum()), total + len(y)
    w, bias, a = np.zeros(BUCKETS), float(np.log((positive + 1) / (total + 1))), np.zeros(4)
    m, v = [np.zeros(BUCKETS), 0.0, np.zeros(4)], [np.zeros(BUCKETS), 0.0, np.zeros(4)]
    ones = np.ones(found.shape[1])
    for step in range(1, rounds + 1):
        grads = [-0.02 * w, 0.0, pairs - 0.02 * a]
        for x, y, at in parts:
            p, joint = marginals(w[x] @ ones + bias, at, a.reshape(2, 2))
            miss = y - p
            grads[0] += np.bincount(x.reshape(-1), np.repeat(miss, x.shape[1]), BUCKETS)
            grads[1] += miss.sum()
            grads[2] -= joint.sum(axis=0)
        moves = []
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            moves.append(0.2 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6))
        w, bias, a = w + moves[0], bias + moves[1], a + moves[2]
    tagger = Tagger(w, a.reshape(2, 2), float(bias), np.zeros(3))
    link, known = np.array([-4.0, 8.0, 0.0]), np.flatnonzero(aside if aside.any() else ~aside)
    x = []
    for low, high in _stretches(np.r_[0, np.cumsum(size[known])]):
        at = np.r_[0, np.cumsum(size[known[low:high]])]
        x.append(summary(tagger.marginals(np.concatenate([found[bounds[d] : bounds[d + 1]] for d in known[low:high].tolist()]), at), at))
    x = np.concatenate(x)
    y = toxic[known].astype(float)
    for _ in range(25):
        q = logistic(x @ link)
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        link = link + np.linalg.solve(hessian, x.T @ (y - q) - 0.05 * (link - [-4.0, 8.0, 0.0]))
    tagger.link = link
    return tagger


def chosen_sample(rows: DataFrame, most: dict[int, int], words: dict[int, int]) -> list[tuple[int, int, int]]:
    """(doc_id, toxic, text hash) of the rows to learn from: in the order of a hash, of each label
    ``most`` rows and ``words`` words at the most; a row too long for the words left is passed over."""
    order = F.xxhash64("doc_id", "text_hash", F.lit(29))
    out = []
    for label in sorted(most):
        left = words[label]
        for r in rows.where(F.col("toxic") == label).select("doc_id", "toxic", "text_hash", "size").orderBy(order, "doc_id", "text_hash").limit(most[label]).collect():
            if r["size"] <= left:
                left -= r["size"]
                out.append((r.doc_id, r.toxic, r.text_hash))
    return out


def train(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE, toxic_words: int = TOXIC_WORDS, clean_words: int = CLEAN_WORDS) -> Tagger:
    """Learn from labelled documents outside the held-out fold, about ``toxic_sample`` and ``clean_sample`` of them
    with ``toxic_words`` and ``clean_words`` words at the most.

    Rows without doc_id or label teach nothing, rows that repeat doc_id and text
    teach once. Only the sample's hashed words, 16 bytes a word, come to the driver.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    parts = [sampled(known.where(F.col("toxic") == t), "toxic", most) for t, most in ((1, toxic_sample), (0, clean_sample))]
    # as many rows of two integers as the samples have
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    rows = rows.withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "toxic", "text_hash"])
    rows = materialise(rows.withColumn("size", F.coalesce(word_count(F.col("text")), F.lit(0))), "toxic-sample")
    taken = chosen_sample(rows, {1: 2 * toxic_sample, 0: 2 * clean_sample}, {1: toxic_words, 0: clean_words})
    taken = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int, text_hash long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            low, first, last, bounds = words_of(part.column("text"))
            found = word_features(low, first, last)
            words = [found[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(words, pa.binary())], names=["doc_id", "toxic", "words"])

    # no more rows than were taken
    held = rows.join(F.broadcast(taken), ["doc_id", "toxic", "text_hash"]).select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, words binary").toArrow()
    place = np.lexsort((held.column("toxic").to_numpy(), held.column("doc_id").to_numpy())) if held.num_rows else np.zeros(0, np.int64)
    toxic = held.column("toxic").to_numpy()[place].astype(bool) if held.num_rows else np.zeros(0, bool)
    words = held.column("words")
    size = np.array([words[i].as_buffer().size // (4 * (1 + len(PREFIXES))) for i in place.tolist()], np.int64)
    found = np.empty((int(size.sum()), 1 + len(PREFIXES)), np.int32)
    bounds = np.r_[0, np.cumsum(size)].astype(np.int64)
    for k, i in enumerate(place.tolist()):
        found[bounds[k] : bounds[k + 1]] = np.frombuffer(words[i].as_buffer(), np.int32).reshape(-1, 1 + len(PREFIXES))
    del held, words
    return fit(found, bounds, toxic)


def score(docs: DataFrame, tagger: Tagger, spans: bool = True, name: str = "toxic_score") -> DataFrame:
    """``docs`` with toxic_score and, unless left out, toxic_spans: code point offsets [start, end).

    All columns of ``docs`` stay but those of the added names, which are replaced.
    Each row is scored by its whole text alone, so repeated rows repeat their score
    and ties need no order. Null and empty texts have the score of a text without a
    toxic word and no spans. A very long text is worked through in stretches of
    words; what grows with it is its bytes and some 60 bytes a word. An empty table
    gives an empty result. The model is of one size whatever the data.
    """
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    added = [name, "toxic_spans"] if spans else [name]
    docs = without(docs, *added)
    names = docs.columns
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    if spans:
        span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
        out.add("toxic_spans", T.ArrayType(span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part in slices(batches):
            text = part.column(part.schema.get_field_index("text"))
            low, first, last, bounds = words_of(text)
            p = model.tag(low, first, last, bounds)
            columns = [*part.columns, pa.array(model.documents(p, bounds))]
            if spans:
                columns.append(_spans(p, bounds, first, last, low, utf8(text)[1]))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return docs.mapInArrow(run, out)


def _points_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes before each place."""
    places = np.unique(np.r_[0, at])
    edges = places[places < len(data)]
    sums = np.add.reduceat((data & 0xC0) != 0x80, edges, dtype=np.int64) if len(edges) else np.zeros(0, np.int64)
    before = np.r_[0, np.cumsum(sums)]
    return before[np.searchsorted(places, at)]


def _spans(p, bounds, first, last, data, text_bounds) -> pa.Array:
    """Runs of toxic words of each row as code point offsets."""
    bad = np.flatnonzero(p >= 0.5)
    row = np.searchsorted(bounds, bad, side="right") - 1
    new = np.r_[True, (np.diff(bad) > 1) | (np.diff(row) > 0)] if len(bad) else np.zeros(0, bool)
    start, end = first[bad[new]], last[bad[np.r_[new[1:], True]]] if len(bad) else np.zeros(0, np.int64)
    row = row[new]
    base = _points_before(data, text_bounds[row])
    ends = [pa.array(_points_before(data, x) - base, pa.int32()) for x in (start, end)]
    pairs = pa.StructArray.from_arrays(ends, names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(row_starts(row, len(bounds) - 1), pa.int32()), pairs)


def op8_toxic_spans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), tagger)
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
