"""Ids of distinct pieces of text, kept by a worker from block to block.

A piece is found by a 64-bit hash of its bytes, and then its bytes are compared with those
that are kept, so two pieces that share a hash never share ids.  Hashes lie in two levels
of sorted arrays, a large one and one of what came since; the bytes and ids of all pieces
share a buffer each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textvec import same_spans

#: Distinct pieces, and bytes of them, that a worker keeps; beyond, it starts anew.
KEPT, KEPT_BYTES = 300_000, 8 << 20
#: Pieces, and bytes of them, that are looked up at a time.
TOGETHER, TOGETHER_BYTES = 1 << 17, 2 << 20


class Store:
    """An array that grows at its end, with eight entries to spare."""

    def __init__(self, dtype: np.dtype):
        self.data, self.used = np.zeros(1 << 16, dtype), 0

    def append(self, more: np.ndarray) -> int:
        if self.used + len(more) + 8 > len(self.data):
            grown = np.zeros(2 * (self.used + len(more)) + 8, self.data.dtype)
            grown[: self.used] = self.data[: self.used]
            self.data = grown
        at, self.used = self.used, self.used + len(more)
        self.data[at: self.used] = more
        return at


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + sizes, sizes)


class PieceTable:
    def __init__(self, dtype: str | np.dtype, kept: int = KEPT):
        self.dtype, self.most = np.dtype(dtype), kept
        self._forget()

    def _forget(self) -> None:
        # Of each known piece: hash, place and number of its ids, place and number of its bytes.
        empty = lambda: (np.empty(0, np.uint64), *(np.empty(0, np.int32) for _ in range(4)))
        self.levels = [empty(), empty()]
        self.ids, self.bytes = Store(self.dtype), Store(np.dtype(np.uint8))

    def _merge(self, level: int, more: tuple[np.ndarray, ...]) -> None:
        both = [np.concatenate(x) for x in zip(self.levels[level], more)]
        rank = np.argsort(both[0], kind="stable")
        self.levels[level] = tuple(x[rank] for x in both)

    def expand(
        self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]],
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of pieces, and after each piece how many there are.

        ``raw`` holds the pieces' bytes.  ``encode`` gets the positions of some pieces and
        returns all their ids in that order and the number for each.
        """
        upto, done, at, found, counts = np.cumsum(ends - starts), 0, 0, [], []
        while at < len(hashes):
            to = min(at + TOGETHER, max(at + 1, int(np.searchsorted(upto, done + TOGETHER_BYTES, side="right"))))
            ids, count = self._expand(hashes[at:to], raw, starts[at:to], ends[at:to], lambda k, at=at: encode(k + at))
            found.append(ids)
            counts.append(count)
            at, done = to, int(upto[to - 1])
        return np.concatenate([np.empty(0, self.dtype), *found]), np.cumsum(np.concatenate([np.empty(0, np.int64), *counts]))

    def _expand(self, hashes, raw, starts, ends, encode) -> tuple[np.ndarray, np.ndarray]:
        if len(self.levels[0][0]) > self.most or self.bytes.used > KEPT_BYTES:
            self._forget()
        low = int(starts[0])
        window = np.zeros(int(ends.max()) - low + 8, np.uint8)
        window[:-8] = raw[low: low + len(window) - 8]
        starts, sizes = starts - low, ends - starts
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        entry = [np.zeros(len(keys), np.int64) for _ in range(4)]
        known = np.zeros(len(keys), bool)
        for have, *columns in self.levels:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                for to, column in zip(entry, columns):
                    to[hit] = column[at[hit]]
                known |= hit
        new = np.flatnonzero(~known)
        if len(new):
            ids, count = encode(first[new])
            size = sizes[first[new]]
            text = self.bytes.append(window[ranges(starts[first[new]], size)]) + np.cumsum(size) - size
            for to, column in zip(entry, (self.ids.append(ids) + np.cumsum(count) - count, count, text, size)):
                to[new] = column
            self._merge(1, (keys[new], *(x[new].astype(np.int32) for x in entry)))
            if 4 * len(self.levels[1][0]) > len(self.levels[0][0]):
                self._merge(0, self.levels[1])
                self.levels[1] = tuple(x[:0] for x in self.levels[1])
        where, count, text, size = (x[which] for x in entry)
        same = size == sizes
        same[same] = same_spans(window, starts[same], self.bytes.data, text[same], sizes[same])
        odd = np.flatnonzero(~same)
        if len(odd):  # other pieces of the same hash
            ids, count[odd] = encode(odd)
            where[odd] = self.ids.append(ids) + np.cumsum(count[odd]) - count[odd]
        return self.ids.data[ranges(where, count)], count
