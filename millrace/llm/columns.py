"""Arrow text columns as flat code points, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the offsets of its rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about ``most`` bytes; a longer row stands alone."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), rows)
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Masks of the first bytes of a little-endian word.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Keys from here on stand for spans of eight bytes or more, and are hashes.
HASHED = np.uint64(0xFF << 56)
#: Spans of more bytes than this have the key 0.
MOST_BYTES = 1024


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte of ``data`` on, as little-endian words; zeros follow the end."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", held, strides=(1,))


def span_hashes(words: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each span of at most MOST_BYTES bytes behind ``words`` (:func:`eights`); of longer ones of their sizes alone."""
    h, at, left = size.astype(np.uint64), starts.copy(), size.copy()
    on = np.flatnonzero(left <= MOST_BYTES)
    while len(on):
        h[on] = mix(h[on] * np.uint64(3) ^ (words[at[on]] & MASKS[np.minimum(left[on], 8)]))
        at[on] += 8
        left[on] -= 8
        on = on[left[on] > 0]
    return h


def span_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A key for each span of the bytes behind ``words``, none of them empty.

    Up to seven bytes are their own key, with their number in the top byte; longer spans have a
    hash, which different spans may share.
    """
    size = ends - starts
    key = (words[starts] & MASKS[np.minimum(size, 8)]) | (np.minimum(size, 8).astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(size > 7)
    key[long] = np.where(size[long] <= MOST_BYTES, span_hashes(words, starts[long], size[long]) | HASHED, np.uint64(0))
    return key


class SpanMap:
    """Values of spans, an open-addressing table that is looked up and filled by whole arrays.

    The bytes behind a hashed key are kept and compared, so no span ever gets another's value.
    """

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int64)
        self.places = np.zeros(1 << bits, np.int32)
        self.sizes = np.zeros(1 << bits, np.int32)
        self.pool, self.used, self.count = np.zeros(1 << 16, np.uint8), 0, 0

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """Where each key stands, or -1."""
        at = (mix(key) & np.uint64(self.mask)).astype(np.int64)
        got = self.keys[at]
        out = np.where((got == key) & (key != 0), at, -1)
        left = np.flatnonzero((got != key) & (got != 0) & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            got = self.keys[at[left]]
            hit = got == key[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit & (got != 0)]
        return out

    def find(self, key: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The value of each span, or -1."""
        slot = self._slots(key)
        out = np.where(slot >= 0, self.values[slot], -1)
        long = np.flatnonzero((slot >= 0) & (key >= HASHED))
        if len(long):
            a, b, left = starts[long], self.places[slot[long]].astype(np.int64), ends[long] - starts[long]
            same = self.sizes[slot[long]] == left
            own, on = np.ndarray(len(self.pool) - 7, "<u8", self.pool, strides=(1,)), np.flatnonzero(same)
            while len(on):
                same[on] &= ((words[a[on]] ^ own[b[on]]) & MASKS[np.minimum(left[on], 8)]) == 0
                a[on] += 8
                b[on] += 8
                left[on] -= 8
                on = on[(left[on] > 0) & same[on]]
            out[long[~same]] = -1
        return out

    def add(self, key: np.ndarray, values: np.ndarray, spans: list[bytes]) -> None:
        """Add different spans; one whose key is 0 or taken is left out."""
        new = np.flatnonzero((key != 0) & (self._slots(key) < 0))
        new = new[np.unique(key[new], return_index=True)[1]]
        held = np.array([len(spans[i]) if key[i] >= HASHED else 0 for i in new.tolist()], np.int64)
        places = self.used + np.cumsum(held) - held
        told = b"".join([spans[i] for i in new.tolist() if key[i] >= HASHED])
        while self.used + len(told) + 8 > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(told)] = np.frombuffer(told, np.uint8)
        self.used += len(told)
        at = (mix(key[new]) & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(new))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = key[new[left[free]]]
            won = self.keys[at[left]] == key[new[left]]
            done = left[won]
            self.values[at[done]], self.places[at[done]], self.sizes[at[done]] = values[new[done]], places[done], held[done]
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask
        self.count += len(new)
