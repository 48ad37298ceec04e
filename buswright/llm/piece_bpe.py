"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a batch stand in one flat array of symbols. Each round
finds the best-ranked adjacent pair of every word by a segmented minimum, merges
its occurrences from the left in all words at once, and compacts the arrays;
words without a pair that merges leave. A merge may create a pair of a rank as
good as the one being merged; a word where it does takes its leftmost occurrence
alone in that round, so the result is that of merging one pair at a time.

A vocabulary piece is never cut by the start of a run of spaces or by a
character that only occurs alone, so texts are encoded word by word.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from buswright.llm.common import row_starts, slices, table, utf8
from buswright.llm.wordcache import WordCache, ragged

_NONE = np.iinfo(np.int32).max
_SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
#: Words of which more symbols than this are left after many rounds are finished by a heap.
_LONG = 512
_ROUNDS = 48


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(message):
        tag, i = number(i)
        if tag & 7 == 0:
            value, i = number(i)
        else:
            if tag & 7 == 2:
                size, i = number(i)
            else:
                size = {1: 8, 5: 4}[tag & 7]
            value, i = message[i : i + size], i + size
        yield tag >> 3, value


class PieceModel:
    """A BPE model with byte fallback, read from the content of a ``.model`` file."""

    def __init__(self, content: bytes):
        pieces: list[tuple[str, float, int]] = []
        spec: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        for field, value in _fields(content):
            if field == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0], x.get(3, _NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec = dict(_fields(value))
        if trainer.get(3) != 2 or spec.get(1) != b"identity" or spec.get(4, 1) or not spec.get(3, 1) or any(p[2] == _USER for p in pieces):
            raise ValueError("only BPE models with identity normalisation, a prefix space and no user pieces are read")
        self.pieces = [p[0] for p in pieces]
        self.kinds = np.array([p[2] for p in pieces])
        self.bytes = np.full(256, -1, np.int32)
        for i, (name, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self.bytes[int(name[3:5], 16)] = i
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte fallback")

        ids = {p[0]: i for i, p in enumerate(pieces) if p[2] == _NORMAL}
        self.normal = ids
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(pieces) + len(symbols))
        self.n_pieces, size = len(pieces), 2 * len(pieces) + len(symbols) + 2
        self.no_symbol, self.size = size - 1, size
        self.of_char = np.full(0x110000, self.no_symbol, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        # equal scores are equal ranks: the leftmost pair goes first
        order = {s: r for r, s in enumerate(sorted({p[1] for p in pieces if p[2] == _NORMAL}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * size + right] = (order[pieces[i][1]], i)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = keys
        self.pair_rank = np.array([pairs[k][0] for k in keys.tolist()], np.int32)
        self.pair_piece = np.array([pairs[k][1] for k in keys.tolist()], np.int32)
        # characters that stand in no longer piece, among them line ends
        self.alone = np.ones(0x110000, bool)
        for p in ids:
            if len(p) > 1:
                self.alone[[ord(c) for c in p]] = False
        self.alone[32] = False
        if any(_SPACE in p.lstrip(_SPACE) for p in ids):
            raise ValueError("a piece has a space inside")

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; the rank is _NONE where they don't merge."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_rank[at], _NONE), self.pair_piece[at]

    def merge(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of words given as code points: (symbols, first code points, symbols a word)."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        symbol, head = self.of_char[chars], chars
        word = np.repeat(np.arange(len(lengths)), lengths)
        rounds = 0
        rank, piece = np.full(len(symbol), _NONE, np.int32), np.zeros(len(symbol), np.int32)
        if len(symbol) > 1:
            rank[:-1], piece[:-1] = self.pair(symbol[:-1], symbol[1:])
            rank[:-1][word[1:] != word[:-1]] = _NONE
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            best = np.minimum.reduceat(rank, first)
            stuck = best == _NONE
            if stuck.any():
                out = np.repeat(stuck, size)
                done.append((word[out], symbol[out], head[out]))
                stay = ~out
                word, symbol, head, rank, piece = word[stay], symbol[stay], head[stay], rank[stay], piece[stay]
                size, best = size[~stuck], best[~stuck]
                if not len(word):
                    break
                first = np.cumsum(size) - size
            rounds += 1
            if rounds > _ROUNDS and size.max() > _LONG:
                self._finish_long(word, symbol, head, first, size, done)
                stay = np.repeat(size <= _LONG, size)
                word, symbol, head, rank, piece = word[stay], symbol[stay], head[stay], rank[stay], piece[stay]
                continue
            level = np.repeat(best, size)
            at = np.flatnonzero(rank == level)
            # of overlapping occurrences every second one, from the left of each run
            run = np.r_[True, np.diff(at) > 1]
            in_run = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[in_run % 2 == 0]
            at = self._safe(at, word, symbol, piece, level)
            merged = piece[at]
            symbol[at] = merged
            stay = np.ones(len(word), bool)
            stay[at + 1] = False
            new = np.cumsum(stay) - 1
            touched = np.unique(np.r_[new[at], new[at][new[at] > 0] - 1])
            word, symbol, head, rank, piece = word[stay], symbol[stay], head[stay], rank[stay], piece[stay]
            rank[-1] = _NONE
            touched = touched[touched < len(word) - 1]
            rank[touched], piece[touched] = self.pair(symbol[touched], symbol[touched + 1])
            rank[touched[word[touched] != word[touched + 1]]] = _NONE
            last = new[at]
            last = last[last == len(word) - 1]
            rank[last] = _NONE
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        word, symbol, head = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbol[order], head[order], np.bincount(word, minlength=len(lengths))

    def _safe(self, at, word, symbol, piece, level) -> np.ndarray:
        """The occurrences to merge now: all of a word's, or its first where a new pair could come in between."""
        merged, own = piece[at], word[at]
        before = np.maximum(at - 1, 0)
        left = symbol[before].copy()
        follows = np.zeros(len(at), bool)
        follows[1:] = at[1:] - at[:-1] == 2
        follows[1:] &= own[1:] == own[:-1]
        left[1:] = np.where(follows[1:], merged[:-1], left[1:])
        rank_left = np.where((at > 0) & (word[before] == own), self.pair(left, merged)[0], _NONE)
        after = np.minimum(at + 2, len(word) - 1)
        rank_right = np.where((at + 2 < len(word)) & (word[after] == own), self.pair(merged, symbol[after])[0], _NONE)
        close = np.minimum(rank_left, rank_right) <= level[at]
        if not close.any():
            return at
        begins = np.r_[True, own[1:] != own[:-1]]
        risky = np.zeros(int(word[-1]) + 1, bool)
        risky[own[close]] = True
        return at[begins | ~risky[own]]

    def _finish_long(self, word, symbol, head, first, size, done) -> None:
        """Long words pair by pair, each in n log n."""
        for f, n in zip(first[size > _LONG].tolist(), size[size > _LONG].tolist(), strict=True):
            s, nxt, prev = symbol[f : f + n].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
            ranks, pieces = self.pair(symbol[f : f + n - 1], symbol[f + 1 : f + n])
            heap = [(r, i, p, s[i], s[i + 1]) for i, (r, p) in enumerate(zip(ranks.tolist(), pieces.tolist(), strict=True)) if r != _NONE]
            heapq.heapify(heap)
            table_ = self._pairs()
            while heap:
                _, i, p, a, b = heapq.heappop(heap)
                j = nxt[i]
                if s[i] != a or j >= n or s[j] != b:
                    continue
                s[i], s[j], nxt[i] = p, -1, nxt[j]
                if nxt[i] < n:
                    prev[nxt[i]] = i
                for x, y in ((prev[i], i), (i, nxt[i])):
                    if x >= 0 and y < n and (hit := table_.get(s[x] * self.size + s[y])):
                        heapq.heappush(heap, (hit[0], x, hit[1], s[x], s[y]))
            stay = np.flatnonzero(np.array(s) >= 0)
            done.append((word[f : f + n][stay], np.array(s, np.int32)[stay], head[f : f + n][stay]))

    def _pairs(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_pair_dict"):
            self._pair_dict = dict(zip(self.pair_keys.tolist(), zip(self.pair_rank.tolist(), self.pair_piece.tolist(), strict=True), strict=True))
        return self._pair_dict

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (UTF-8, spaces as spaces) in a row, and how many each has."""
        text = [w.decode("utf-8", "replace").replace(" ", _SPACE) for w in words]
        lengths = np.array([len(t) for t in text], np.int64)
        chars = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        symbol, head, counts = self.merge(chars, lengths)
        missing = np.flatnonzero(symbol >= self.n_pieces)
        if not len(missing):
            return symbol, counts
        # a character without a piece of its own becomes its UTF-8 bytes
        spelled = [chr(c).encode() for c in head[missing].tolist()]
        width = np.ones(len(symbol), np.int64)
        width[missing] = [len(b) for b in spelled]
        out = np.repeat(symbol, width)
        begin = (np.cumsum(width) - width)[missing]
        out[ragged(begin, width[missing])] = self.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
        word = np.repeat(np.arange(len(words)), counts)
        return out, np.bincount(word, weights=width, minlength=len(words)).astype(np.int64)


class PieceCodec:
    """Encodes batches of texts and decodes ids."""

    def __init__(self, content: bytes):
        self.model = PieceModel(content)
        self.cache = WordCache(self.model.encode_words)
        m = self.model
        self.shown = np.array([("" if k == _CONTROL else " ⁇ " if k == _UNKNOWN else p.replace(_SPACE, " ")) for p, k in zip(m.pieces, m.kinds.tolist(), strict=True)], object)
        self.byte_of = np.full(m.n_pieces, -1, np.int32)
        self.byte_of[m.bytes] = np.arange(256)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text in them. Null is empty."""
        data, bounds = utf8(texts)
        filled = np.flatnonzero(np.diff(bounds))
        rows = len(bounds) - 1
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        if (data == 0xE2).any() and _SPACE.encode() in (raw := data.tobytes()):
            parts = [raw[a:b].replace(_SPACE.encode(), b" ") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
            data = np.frombuffer(b"".join(parts), np.uint8)
        # each text that isn't empty begins with a space of the encoder's own
        grown = np.insert(data, bounds[:-1][filled], 32)
        bounds = bounds + np.r_[0, np.cumsum(np.diff(bounds) > 0)]
        space, alone = grown == 32, (grown < 128) & self.model.alone[grown]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins |= alone
        begins[1:] |= alone[:-1]
        begins[bounds[:-1][filled]] = True
        starts = np.flatnonzero(begins)
        ids, counts = self.cache(grown, starts, np.r_[starts[1:], len(grown)])
        of_word = np.r_[0, np.cumsum(counts)]
        row = np.searchsorted(bounds, starts, side="right") - 1
        return ids, of_word[row_starts(row, rows)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The text in UTF-8 of each row of ids."""
        spelled = self.byte_of[ids] >= 0
        shown = self.shown[ids]
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                out.append(b"")
                continue
            row = shown[a:b].tolist()
            marks = np.flatnonzero(spelled[a:b])
            if len(marks):
                codes = self.byte_of[ids[a:b][marks]].astype(np.uint8)
                for run, value in zip(np.split(marks, np.flatnonzero(np.diff(marks) > 1) + 1), np.split(codes, np.flatnonzero(np.diff(marks) > 1) + 1), strict=True):
                    row[run[0] : run[-1] + 1] = [value.tobytes().decode("utf-8", "replace")] + [""] * (len(run) - 1)
            # the encoder's own space goes
            if row[0].startswith(" ") and not spelled[a]:
                row[0] = row[0][1:]
            out.append("".join(row).encode())
        return out


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"


def model_content(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model: bytes, digests_only: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and,
    unless ``digests_only``, ids and the decoded text.

    Null and empty texts have no ids and decode to an empty text. Rows are
    independent of each other, so repeated rows give repeated results, a null
    doc_id stays null, other columns are ignored and an empty table gives an empty
    result. The model's content (half a megabyte) goes to every task.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(SCHEMA.split(", ")[:4]) if digests_only else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(held.value)
        numbers = np.array([str(i) for i in range(codec.model.n_pieces)], object)
        for part in slices(batches, most=1_000_000):
            ids, bounds = codec.encode(part.column("text"))
            decoded = codec.decode(ids, bounds)
            names = numbers[ids].tolist()
            rows = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            columns = [
                part.column("doc_id").cast(pa.int64()),
                pa.array(np.diff(bounds), pa.int64()),
                pa.array([hashlib.sha256(",".join(names[a:b]).encode()).hexdigest() for a, b in rows], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            ]
            if not digests_only:
                columns += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), pa.array([d.decode() for d in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_piece_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), model_content(), digests_only=True)
