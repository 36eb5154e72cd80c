"""Whole texts to token ids with a byte-level BPE file of the ``tokenizers`` library.

The pre-tokeniser of these files always ends a token before a space that stands between
two visible characters, and before a mark of ``,.;:!?`` that follows a letter.  A text is
cut there, with vector operations over the bytes of a whole block of texts, and each
distinct piece is encoded once by the library and kept in a bounded table.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .piece_table import PieceTable
from .textvec import buffer_of, hash_spans

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that go through the library in one text.
TOGETHER = 2000

_BYTE = np.arange(256)
_ASCII = (_BYTE > 0x20) & (_BYTE < 0x7F)
_LETTER = ((_BYTE | 0x20) >= 0x61) & ((_BYTE | 0x20) <= 0x7A)
_LEAD = (_BYTE >= 0xC3) & (_BYTE <= 0xC9)  # of U+00C0 to U+027F, letters but for two signs
_MARK = np.isin(_BYTE, np.frombuffer(b",.;:!?", np.uint8))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of a buffer of texts start: at each text's first byte and at each cut."""
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 2:
        before, here, after = raw[:-2], raw[1:-1], raw[2:]
        two = np.zeros(len(raw) - 2, bool)  # the two bytes before are such a letter
        sign = (before == 0x97) | (before == 0xB7)
        two[1:] = _LEAD[raw[:-3]] & ~((raw[:-3] == 0xC3) & sign[1:])
        sure = two | _ASCII[before]
        space = (here == 0x20) & sure & (_ASCII[after] | _LEAD[after])
        mark = _MARK[here] & (two | _LETTER[before])
        cut[1:-2] = space | mark
    cut[bounds] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Encodes blocks of texts; keep one for a worker process."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():  # a character of a token stands for a byte
            self.bytes_of[i] = len(token)
        self.table = PieceTable(self.dtype)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some pieces in order, and the number for each."""
        sizes, counts, low = ends - starts, np.zeros(len(starts), np.int64), int(starts.min())
        data, parts, order = raw[low: int(ends.max())].tobytes(), [], []
        spaced = raw[starts] == 0x20
        alone = np.flatnonzero(~spaced)
        for i, ids in zip(alone, self._library([data[a:b].decode() for a, b in zip(starts[alone] - low, ends[alone] - low)])):
            counts[i] = len(ids)
            parts.append(ids)
        order.append(alone)
        joined = np.flatnonzero(spaced)
        for at in range(0, len(joined), TOGETHER):
            some = joined[at: at + TOGETHER]
            ids = self._library([b"".join([data[a:b] for a, b in zip((starts[some] - low).tolist(), (ends[some] - low).tolist())]).decode()])[0]
            want, done = np.cumsum(sizes[some]), np.cumsum(self.bytes_of[ids])
            to = np.searchsorted(done, want) + 1
            if not np.array_equal(done[to - 1], want):
                raise ValueError("a token crosses a border between pieces")
            counts[some] = np.diff(to, prepend=0)
            parts.append(ids)
            order.append(some)
        rank = np.concatenate(order)
        ids = np.concatenate(parts) if parts else np.empty(0, self.dtype)
        begins = np.empty(len(starts), np.int64)
        begins[rank] = np.cumsum(counts[rank]) - counts[rank]
        total = np.cumsum(counts)
        return ids[np.arange(len(ids)) + np.repeat(begins - total + counts, counts)], counts

    def flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array and the bounds of each text in it; ``end`` is
        put after each text if given.  A null text counts as empty."""
        raw, bounds = buffer_of(texts)  # with a newline after each text, which isn't part of it
        n = len(bounds) - 1
        starts = piece_starts(raw, bounds)
        ends = np.append(starts[1:], len(raw))
        last = np.searchsorted(starts, bounds[1:]) - 1
        ends[last] -= 1
        hashes = hash_spans(raw, starts, ends, lower=False)
        ids, total = self.table.expand(hashes, raw, starts, ends, lambda at: self._new(raw, starts[at], ends[at]))
        out_bounds = np.concatenate(([0], total[last])) if n else np.zeros(1, np.int64)
        if end is not None:
            full = np.empty(len(ids) + n, self.dtype)
            out_bounds = out_bounds + np.arange(n + 1)
            mark = np.zeros(len(full), bool)
            mark[out_bounds[1:] - 1] = True
            full[mark] = end
            full[~mark] = ids
            ids = full
        return ids, out_bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
