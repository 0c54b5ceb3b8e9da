"""Splitting texts into pre-tokens and encoding them through caches, a block of rows at a time.

The split is that of the byte-level pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

worked out on arrays of code points instead of match by match: runs of one class are tokens,
the last blank of a white-space run goes to what follows, and an apostrophe that opens its run
takes a contraction's letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from .columns import SpanMap, blocks, eights, span_keys
from .words import Numbers

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Bytes of text that are encoded at a time.
BLOCK_BYTES = 1 << 20
#: The code points with the White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, made once in a process."""
    if not _CLASSES:
        kinds = "".join(map(unicodedata.category, map(chr, range(0x110000))))[::2]
        first = np.frombuffer(kinds.encode("ascii"), np.uint8)
        table = np.where(first == ord("L"), LETTER, np.where(first == ord("N"), NUMBER, OTHER)).astype(np.uint8)
        table[WHITE] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def split(cp: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the rows that begin at ``rows[:-1]`` (``rows[-1]`` is the length)."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    edge = np.zeros(n + 1, bool)  # where a row begins or all ends
    edge[rows] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # a white-space run before other text in its row gives up its last character
    inner = start & ~edge[:-1]
    last = np.flatnonzero(inner[1:] & (kind[:-1] == SPACE))
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    # contractions
    i = np.flatnonzero(start & (cp == 0x27))
    i = i[i + 1 < n]
    i = i[(kind[i + 1] == LETTER) & ~edge[i + 1]]
    if len(i):
        a = cp[i + 1]
        b = np.where((i + 2 < n) & ~edge[np.minimum(i + 2, n)], cp[np.minimum(i + 2, n - 1)], 0)
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = (np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[i[two | three] + 1] = False
        for more, at in ((2, i[two]), (3, i[three])):
            at = at + more
            start[at[at < n]] = True
    return np.flatnonzero(start)


def spans(cp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens."""
    starts = split(cp, rows)
    return starts, np.append(starts[1:], len(cp))[: len(starts)]


class Encoder:
    """Encodes rows by way of pre-tokens: a fixed first tier, then a cache that a worker fills.

    ``encode`` turns a list of different pre-tokens into lists of ids.  Both tiers compare the
    bytes of a pre-token before they answer for it, so answers do not depend on what a worker
    has seen.  The cache is emptied when it holds ``most`` pre-tokens.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], most: int = 1 << 19, counts_only: bool = False):
        self.encode, self.most, self.counts_only = encode, most, counts_only
        self.first: SpanMap | None = None
        self.clear()

    def clear(self) -> None:
        self.cache = SpanMap((self.most - 1).bit_length() + 1)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def preload(self, spans: list[bytes], values: np.ndarray) -> None:
        """The first tier: the lengths of frequent pre-tokens, for :meth:`counts`."""
        self.first = SpanMap(max(1, len(spans)).bit_length() + 1)
        if spans:
            ends = np.cumsum([len(x) for x in spans])
            starts = np.concatenate([[0], ends[:-1]])
            self.first.add(span_keys(eights(np.frombuffer(b"".join(spans), np.uint8)), starts, ends), values.astype(np.int64), spans)

    def _values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pre-token of the rows its number of ids, or its place in the pool times 2**24 plus that; and where each row's begin."""
        raw = data.tobytes()
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each code point
        starts = at[split(cp, np.searchsorted(at, offsets))]
        ends = np.append(starts[1:], len(data))[: len(starts)]
        words = eights(data)
        keys = span_keys(words, starts, ends)
        if self.first is not None:
            out = self.first.find(keys, words, starts, ends)
            left = np.flatnonzero(out < 0)
            out[left] = self.cache.find(keys[left], words, starts[left], ends[left])
        else:
            out = self.cache.find(keys, words, starts, ends)
        left = np.flatnonzero(out < 0)
        if len(left):
            numbers = Numbers()
            back = np.fromiter([numbers[raw[a:b]] for a, b in zip(starts[left].tolist(), ends[left].tolist(), strict=True)], np.int64, len(left))
            spans = list(numbers)
            ids = self.encode([x.decode() for x in spans])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            values = sizes
            if not self.counts_only:
                values = ((self.used + np.cumsum(sizes) - sizes) << 24) | sizes
                total = int(sizes.sum())
                while self.used + total > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
                self.pool[self.used : self.used + total] = [x for own in ids for x in own]
                self.used += total
            out[left] = values[back]
            if self.cache.count + len(spans) <= self.most:
                one = np.unique(back, return_index=True)[1]
                self.cache.add(keys[left[one]], values, spans)
        return out, np.searchsorted(starts, offsets)

    def _room(self) -> None:
        if self.cache.count > self.most * 0.9 or self.used > 8 * self.most or self.cache.used > 32 * self.most:
            self.clear()

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of ids of each row."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for a, b in blocks(data, offsets, BLOCK_BYTES):
            lo = offsets[a]
            values, rows = self._values(data[lo : offsets[b]], offsets[a : b + 1] - lo)
            if not self.counts_only:
                values = values & 0xFFFFFF
            sums = np.concatenate([[0], np.cumsum(values)])
            out[a:b] = np.diff(sums[rows])
            self._room()
        return out

    def ids(self, data: np.ndarray, offsets: np.ndarray):
        """For each block of rows: its first row, its ids end to end, and the offsets of its rows in them."""
        for a, b in blocks(data, offsets, BLOCK_BYTES):
            lo = offsets[a]
            values, rows = self._values(data[lo : offsets[b]], offsets[a : b + 1] - lo)
            sizes = values & 0xFFFFFF
            sums = np.concatenate([[0], np.cumsum(sizes)])
            flat = self.pool[np.repeat((values >> 24) - sums[:-1], sizes) + np.arange(sums[-1])]
            yield a, flat, sums[rows]
            self._room()
