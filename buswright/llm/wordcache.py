"""Encoding texts by their distinct words.

An encoder whose output for a text is the concatenation of its outputs for the
text's words needs to see each distinct word once. A cache keeps what it gave
for the words of earlier batches in the same task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from buswright.llm.common import block_hashes, word_blocks


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``offsets[i] .. offsets[i] + lengths[i] - 1`` for all i, one after another."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1])) + np.repeat(offsets - (ends - lengths), lengths)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Which of the distinct words each word is, and the distinct words.

    Hashes bring equal words together; then the bytes of each are compared with
    those of the first of its hash, and words that differ get numbers of their own.
    """
    lengths = ends - starts
    blocks, first_block, counts = word_blocks(data, starts, ends)
    which, hashes = pd.factorize(block_hashes(blocks, first_block, counts, lengths))
    which = which.astype(np.int64)
    first = np.empty(len(hashes), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    model = first[which]
    differs = lengths != lengths[model]
    same = np.flatnonzero(~differs)
    unlike = blocks[ragged(first_block[same], counts[same])] != blocks[ragged(first_block[model[same]], counts[same])]
    differs[np.repeat(same, counts[same])[unlike]] = True
    raw = data.tobytes()
    words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    more: dict[bytes, int] = {}
    for i in np.flatnonzero(differs).tolist():
        word = raw[int(starts[i]) : int(ends[i])]
        if word not in more:
            more[word] = len(words)
            words.append(word)
        which[i] = more[word]
    return which, words


class WordCache:
    """``encode(words)`` takes byte strings and returns their ids in a row and how many each has.

    Words are told apart by their bytes. ``limit`` bounds the words kept, not the
    words encoded: a full cache starts anew. Words over ``longest`` bytes aren't
    kept.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000, longest: int = 256):
        self.encode, self.limit, self.longest = encode, limit, longest
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.offsets, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[start:end]`` one after another, and how many each word has."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        which, words = distinct_words(data, starts, ends)
        if len(self.known) + len(words) > self.limit:
            self.clear()
        at = np.array([self.known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(at < 0)
        ids, offsets, lengths = self.ids, self.offsets, self.lengths
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            more, sizes = self.encode(fresh)
            at[new] = len(lengths) + np.arange(len(new))
            ids, offsets = np.concatenate([ids, more.astype(np.int32)]), np.concatenate([offsets, len(ids) + np.cumsum(sizes) - sizes])
            lengths = np.concatenate([lengths, sizes])
            # long words are a batch's own: they stand last and are forgotten
            short = np.array([len(w) <= self.longest for w in fresh], bool)
            if short.all():
                self.ids, self.offsets, self.lengths = ids, offsets, lengths
                self.known.update(zip(fresh, at[new].tolist(), strict=True))
            else:
                keep = np.flatnonzero(short)
                base, own = len(self.lengths), more[ragged((np.cumsum(sizes) - sizes)[keep], sizes[keep])]
                self.offsets = np.concatenate([self.offsets, len(self.ids) + np.cumsum(sizes[keep]) - sizes[keep]])
                self.ids, self.lengths = np.concatenate([self.ids, own.astype(np.int32)]), np.concatenate([self.lengths, sizes[keep]])
                self.known.update((fresh[i], base + k) for k, i in enumerate(keep.tolist()))
        entry = at[which]
        counts = lengths[entry]
        return ids[ragged(offsets[entry], counts)], counts
