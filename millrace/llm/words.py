"""Words of whole texts as arrays: which they are, what repeats.

A word is a run of bytes other than U+0020 and U+0009 to U+000D, which is what ``bytes.split``
takes for one.  Inside a block of rows words bear numbers given by comparing them whole, and
windows of words bear numbers made from those, so counts, repeats and sets are exact; hashes
only serve where tasks must agree on a number: for signatures and for hash buckets.
"""

from __future__ import annotations

import hashlib
from functools import cached_property
from itertools import chain

import numpy as np

from .columns import MOST_BYTES, eights, mix, span_hashes

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Numbers of windows stay below this, so that they fit 64 bits.
ROOM = 1 << 62


class Numbers(dict):
    """Numbers things from 0 in the order of their first look-up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def digests(words) -> np.ndarray:
    """A 64-bit hash of each of the given words, the same in every process."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(size) - size
    h = span_hashes(eights(np.frombuffer(b"".join(words), np.uint8)), starts, size)
    for i in np.flatnonzero(size > MOST_BYTES).tolist() if len(words) else ():
        h[i] = int.from_bytes(hashlib.blake2b(list(words)[i], digest_size=8).digest(), "little")
    return h


class Words:
    """The words of a block of rows, end to end; ``first[r]`` is the first word of row r."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets, self.n_rows = data, offsets, len(offsets) - 1
        raw, ends = data.tobytes(), offsets.tolist()
        if lower:
            raw = raw.lower()  # bytes: A-Z alone
        self.texts = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.by_row = [t.split() for t in self.texts]
        self.counts = np.fromiter(map(len, self.by_row), np.int64, self.n_rows)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.rows = np.repeat(np.arange(self.n_rows), self.counts)
        numbers = Numbers()
        self.ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(self.by_row)), np.int64, int(self.first[-1]))
        self.kinds = numbers

    @cached_property
    def hashes(self) -> np.ndarray:
        """The digest of each word."""
        return digests(self.kinds)[self.ids] if len(self.ids) else np.zeros(0, np.uint64)

    def starts(self, n: int) -> np.ndarray:
        """First words of the n-word windows within rows."""
        k = len(self.ids) - n + 1
        return np.flatnonzero(self.rows[:k] == self.rows[n - 1 :]) if k > 0 else np.zeros(0, np.int64)

    def windows(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows within rows, and their first words."""
        at = self.starts(n)
        own, h = self.hashes if hashes is None else hashes, np.zeros(len(at), np.uint64)
        for i in range(n):
            h = mix(h + own[at + i])
        return h, at

    def numbered(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the n-word windows within rows, equal only for equal windows, and their first words."""
        at = self.starts(n)
        key, kinds = np.zeros(len(at), np.int64), 1
        for i in range(n):
            if kinds * max(1, len(self.kinds)) >= ROOM:
                some, key = np.unique(key, return_inverse=True)
                kinds = max(1, len(some))
            key = key * max(1, len(self.kinds)) + self.ids[at + i]
            kinds *= max(1, len(self.kinds))
        return key, at

    def numbered_in_rows(self, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        """As :meth:`numbered`, but row times ``top`` plus the window's number; also ``top``."""
        key, at = self.numbered(n)
        top = int(key.max()) + 1 if len(key) else 1
        if top * max(1, self.n_rows) >= ROOM:
            some, key = np.unique(key, return_inverse=True)
            top = len(some)
        return self.rows[at] * top + key, at, top

    def per_row(self, at: np.ndarray) -> np.ndarray:
        """How many of the byte positions ``at`` (ascending) each row holds."""
        return np.diff(np.searchsorted(at, self.offsets))

    def row_sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each row."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def duplicate_lines(self) -> np.ndarray:
        """Of each row, lines that hold a word and equal an earlier line of the row."""
        out = np.zeros(self.n_rows, np.int64)
        for r, t in enumerate(self.texts):
            if b"\n" in t:
                lines = [x for x in t.split(b"\n") if x and not x.isspace()]
                out[r] = len(lines) - len(set(lines))
        return out

    def repeated_words(self, n: int = 3) -> np.ndarray:
        """Of each row, words in n-word windows that the row holds twice or more."""
        key, at, _ = self.numbered_in_rows(n)
        if not len(key):
            return np.zeros(self.n_rows, np.int64)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        over = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(over, at[twice], 1)
        np.subtract.at(over, at[twice] + n, 1)
        return self.row_sums(np.cumsum(over[:-1]) > 0)
