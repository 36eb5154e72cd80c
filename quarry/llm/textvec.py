"""Words and 64-bit hashes of whole texts, vectorised over Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, which equals
``[^\\x20\\x09-\\x0D]+`` on the decoded text.  A word's hash starts from its length and
takes in eight bytes at a time, each step being a bijection of them, so that words of up
to eight bytes and of one length never share a hash; a word of more than ``LONG`` bytes
is hashed by BLAKE2.  It is the same in every process and on every machine.  Among n
distinct longer words n**2 / 2**65 pairs are expected to share one; where that isn't
enough, ``same_spans`` compares the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Spans hashed or compared at a time.
BLOCK = 1 << 17
#: Bytes from which a span is taken as a whole and not in steps of eight.
LONG = 512
#: Bytes of text taken from an Arrow batch at a time; one longer text goes alone.
SLICE = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Which bytes of a little-endian word of eight belong to the first 0 to 8.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    return mix(a * _U(0xD6E8FEB86659FD93) + b + _U(0x2545F4914F6CDD1D))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``most`` bytes of text, or one row."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < n:
        done = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a newline, and where each text starts
    (one more entry for the end).  A null text counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    joined = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    _, offsets, data = joined.buffers()
    starts = np.frombuffer(offsets, np.int64)[joined.offset: joined.offset + len(joined) + 1]
    raw = np.frombuffer(data, np.uint8)[starts[0]: starts[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, starts - starts[0]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; the buffer ends in white space."""
    blank = SPACE[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(raw) and not blank[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def _eights(raw: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A padded copy of the buffer, and the eight bytes from each place on as a number."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:-8] = _LOWER[raw] if lower else raw
    return padded, np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """The hash of each span of the buffer; spans are ascending."""
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), BLOCK):
        s, e = starts[at: at + BLOCK], ends[at: at + BLOCK]
        low = int(s[0])
        padded, eights = _eights(raw[low: int(e.max())], lower)
        s, size = s - low, e - s
        h = mix(size.astype(np.uint64) * _U(0xA24BAED4963EE407) + _U(0x9E3779B97F4A7C15))
        rest = np.flatnonzero((size > 0) & (size <= LONG))
        for done in range(0, LONG, 8):
            if done:
                rest = rest[size[rest] > done]
            if not len(rest):
                break
            h[rest] = mix(h[rest] ^ (eights[s[rest] + done] & _MASK[np.minimum(size[rest] - done, 8)]))
        for k in np.flatnonzero(size > LONG).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(padded[s[k]: s[k] + size[k]], digest_size=8).digest(), "little")
        out[at: at + BLOCK] = h
    return out


def same_spans(one: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from each ``a`` in one buffer equal those from ``b`` in the other.
    Both buffers have eight bytes more than any span needs."""
    view = lambda raw: np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    x, y, out = view(one), view(other), np.ones(len(a), bool)
    rest = np.flatnonzero((size > 0) & (size <= LONG))
    for done in range(0, LONG, 8):
        rest = rest[size[rest] > done]
        if not len(rest):
            break
        differ = (x[a[rest] + done] ^ y[b[rest] + done]) & _MASK[np.minimum(size[rest] - done, 8)]
        out[rest[differ != 0]] = False
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = np.array_equal(one[a[k]: a[k] + size[k]], other[b[k]: b[k] + size[k]])
    return out


def words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and bounds: the words of text i are
    ``hashes[bounds[i]:bounds[i + 1]]``."""
    raw, at = buffer_of(texts)
    starts, ends = word_spans(raw)
    return hash_spans(raw, starts, ends, lower), np.searchsorted(starts, at)
