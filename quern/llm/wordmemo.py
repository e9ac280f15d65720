"""Token ids of texts by way of their distinct words.

Tokenizers that never join characters across a cut (white space here) give a text the ids of its words in order.  A batch's
words are made distinct by Arrow, only those not yet known go through the tokenizer, and the texts' ids are gathered by index.
The memory of known words is bounded; results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the slices that start here and have these sizes."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class WordMemo:
    """Remembers the ids of words of at most ``longest`` characters.

    Ids stand one after the other in an array, and a word is known by its place.  Beyond ``most`` words, or ``room`` ids, all are
    forgotten but those of the texts at hand, among which are the frequent ones.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], most: int = 300_000, longest: int = 48, room: int = 4_000_000):
        self.encode, self.most, self.longest, self.room = encode, most, longest, room
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and the number of ids of each word."""
        coded = words.dictionary_encode()
        names, index = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        known = self.known
        place = np.fromiter([known.get(n, -1) for n in names], np.int64, len(names))
        gaps = np.flatnonzero(place < 0)
        if len(gaps):
            if len(known) > self.most or len(self.flat) > self.room:
                held = np.flatnonzero(place >= 0)
                old = place[held]
                self.flat = self.flat[ragged(self.starts[old], self.sizes[old])]
                self.sizes = self.sizes[old]
                self.starts = np.cumsum(self.sizes) - self.sizes
                place[held] = np.arange(len(held))
                self.known = known = dict(zip(names[held].tolist(), range(len(held)), strict=True))
            new = names[gaps].tolist()
            lists = self.encode(new)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
            first, longest = len(self.starts), self.longest
            place[gaps] = first + np.arange(len(gaps))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
            known.update((n, k) for k, n in enumerate(new, first) if len(n) <= longest)
        starts, sizes = self.starts[place], self.sizes[place]
        return self.flat[ragged(starts[index], sizes[index])], sizes[index]


class WordTable:
    """As ``WordMemo``, with the known words in an Arrow array that a batch's words are made distinct behind.

    A word's place in that array is its place among the ids, so no word that is known becomes a Python string.  Beyond ``most``
    words, or ``room`` ids, those stay that most batches held (older batches count less), up to half of either bound.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], most: int = 250_000, longest: int = 48, room: int = 4_000_000):
        self.encode, self.most, self.longest, self.room = encode, most, longest, room
        self.known, self.uses = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def keep(self, places: np.ndarray) -> None:
        """Forgets all words but those at these places."""
        self.known, self.uses = self.known.take(pa.array(places)), self.uses[places]
        self.flat, self.sizes = self.flat[ragged(self.starts[places], self.sizes[places])], self.sizes[places]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and the number of ids of each word."""
        if len(self.known) > self.most or len(self.flat) > self.room:
            often = np.argsort(-self.uses, kind="stable")[: self.most // 2]
            self.keep(np.sort(often[np.cumsum(self.sizes[often]) <= self.room // 2]))
            self.uses >>= 1
        old = len(self.known)
        coded = pa.concat_arrays([self.known, words]).dictionary_encode()
        index, new = coded.indices.to_numpy()[old:], coded.dictionary.slice(old)
        lists = self.encode(new.to_numpy(zero_copy_only=False).tolist()) if len(new) else []
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
        self.known = coded.dictionary
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)]) + (np.bincount(index, minlength=old + len(new)) > 0)
        starts, sizes = self.starts[index], self.sizes[index]
        out = self.flat[ragged(starts, sizes)]
        short = pc.less_equal(pc.utf8_length(new), self.longest).to_numpy(zero_copy_only=False)
        if not short.all():
            self.keep(np.append(np.arange(old), old + np.flatnonzero(short)))
        return out, sizes


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the slices between offsets; empty slices give 0."""
    total = np.append(0, np.cumsum(values))
    return total[offsets[1:]] - total[offsets[:-1]]
