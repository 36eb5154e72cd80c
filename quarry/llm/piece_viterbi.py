"""SentencePiece encoding and decoding by a single-pass Viterbi over an Aho-Corasick automaton.

The automaton holds all ordinary pieces.  Reading a text once, it yields at each position
the pieces that end there, the longest and then, along the output links, its suffixes; each
relaxes the best score of that position from the best score where it starts.  A character
that no piece covers falls back to its bytes.

The vocabulary comes from a public model file, which ranks its pieces but has no
probabilities (its scores are merge ranks), so a piece's score is its log probability under
Zipf's law over the ranks, and a byte's is ``BYTE_PENALTY`` below the lowest.  The encoding
is the segmentation of the highest total score (of equals, the one whose last piece is
longest, and so on backwards); it is not the merge order that the file was made for.

Where two adjacent characters stand in no piece side by side, a piece must end, so texts are
cut there with vector operations and each distinct part is segmented once and kept in a
bounded table.

Normalisation: one space is put before a text that isn't empty, and spaces become U+2581.
U+2581 itself goes through its bytes, so decoding gives back every text exactly.  Edge
cases: null and empty texts have no ids; repeated rows each get their row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_table import PieceTable
from .textvec import hash_spans, slices
from .workers import lean

VOCABULARY = "piece_bpe_32k.model"
SPACE, LITERAL = 0x2581, 0x110000  # the mark for a space, and what stands for that character itself
BYTE_PENALTY = 10.0
#: Code points of text taken at a time.
PART = 1 << 19
#: Code points from which a part's states are held in machine types.
MANY = 1 << 12
_LOW = 0x250
_BYTE = re.compile(r"<0x([0-9A-F]{2})>$")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The vocabulary of a model file: pieces, scores and bytes by id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        skip = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_id = {int(_BYTE.match(names[i])[1], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if i not in skip and not model.is_byte(i)]
        if len(self.byte_id) < 256:
            raise ValueError(f"{path} has no piece for every byte")
        self.names = names
        rank = np.full(n, len(plain), np.float64)
        rank[plain] = np.argsort(np.argsort([-model.get_score(i) for i in plain], kind="stable"), kind="stable")
        self.score = -np.log(rank + 1) - np.log(np.sum(1 / np.arange(1, len(plain) + 1)))
        lowest = self.score[plain].min()
        for i in (*self.byte_id.values(), *skip):
            self.score[i] = lowest - BYTE_PENALTY
        self.plain = plain
        text = [b""] * n
        for i in plain:
            text[i] = names[i].replace(chr(SPACE), " ").encode()
        for byte, i in self.byte_id.items():
            text[i] = bytes([byte])
        self.sizes = np.array([len(t) for t in text], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        # Which two characters stand side by side in some piece; beyond U+0250 any may.
        self.beside = np.zeros((_LOW + 2, _LOW + 2), bool)
        for i in plain:
            codes = self.codes(np.array([ord(c) for c in names[i]], np.uint32))
            self.beside[codes[:-1], codes[1:]] = True

    @staticmethod
    def codes(points: np.ndarray) -> np.ndarray:
        """Code points below U+0250, then one for the space mark and one for all others."""
        return np.where(points < _LOW, points, np.where(points == SPACE, _LOW, _LOW + 1)).astype(np.int64)


class Encoder:
    """Encodes and decodes blocks of texts; keep one for a worker process."""

    def __init__(self, path: str | None = None):
        import ahocorasick

        self.pieces = Pieces(path or vocabulary_path())
        self.automaton = ahocorasick.Automaton()
        for i in self.pieces.plain:
            self.automaton.add_word(self.pieces.names[i], (len(self.pieces.names[i]), float(self.pieces.score[i]), i))
        self.automaton.make_automaton()
        self.lengths = [len(x) for x in self.pieces.names]
        self.byte_score = float(self.pieces.score[self.pieces.byte_id[0]])
        self.table = PieceTable("<u2" if len(self.pieces.names) < 1 << 16 else "<u4")

    def _fallback(self, point: int) -> list[int]:
        text = " " if point == SPACE else chr(SPACE) if point == LITERAL else chr(point)
        return [self.pieces.byte_id[b] for b in text.encode()]

    def segment(self, text: str, points: np.ndarray, own: np.ndarray) -> list[int] | array:
        """The ids of the best segmentation of a piece of text: ``points`` are its code points,
        ``own`` the scores of their bytes."""
        n = len(text)
        if n < MANY:
            own, best, back = own.tolist(), [0.0] * (n + 1), [-1] * (n + 1)
        else:
            best, back = array("d", bytes(8 * (n + 1))), array("i", b"\xff" * 4 * (n + 1))
        done = 0
        for end, (size, score, piece) in self.automaton.iter(text):
            while done <= end:  # bytes are always possible, and come first
                best[done + 1] = best[done] + own[done]
                done += 1
            total = best[end + 1 - size] + score
            if total > best[end + 1] or back[end + 1] < 0 and total == best[end + 1]:
                best[end + 1], back[end + 1] = total, piece
        out, at, sizes = [] if n < MANY else array("i"), n, self.lengths
        while at:
            piece = back[at]
            if piece < 0:
                at -= 1
                out.extend(reversed(self._fallback(int(points[at]))))
            else:
                at -= sizes[piece]
                out.append(piece)
        out.reverse()
        return out

    def _new(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = int(starts.min())
        points = points[low: int(ends.max())]
        text = np.where(points == LITERAL, 0x10FFFF, points).astype("<u4").tobytes().decode("utf-32-le")
        own = np.where(points == SPACE, 1, np.where(points == LITERAL, 3, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))) * self.byte_score
        ids, counts = array("i"), np.empty(len(starts), np.int64)
        for k, (a, b) in enumerate(zip((starts - low).tolist(), (ends - low).tolist())):
            before = len(ids)
            ids.extend(self.segment(text[a:b], points[a:b], own[a:b]))
            counts[k] = len(ids) - before
        return np.array(ids, self.table.dtype), counts

    def _parts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bool]]:
        """The code points of the texts, whole texts together up to a size or a part of a long
        one, and whether the part ends its text (else it ends where a piece must)."""
        for text in texts:
            if not text:
                yield np.empty(0, np.uint32), True
                continue
            held = np.empty(0, np.uint32)
            for at in range(0, len(text), PART):
                more = (" " if not at else "") + text[at: at + PART]
                more = np.frombuffer(more.encode("utf-32-le"), "<u4").copy()
                more[more == SPACE] = LITERAL
                more[more == 0x20] = SPACE
                held = np.concatenate((held, more)) if len(held) else more
                if at + PART >= len(text):
                    yield held, True
                elif len(edges := np.flatnonzero(self._borders(held)[1:-1])):
                    yield held[: edges[-1] + 1], False
                    held = held[edges[-1] + 1:]

    def _borders(self, points: np.ndarray) -> np.ndarray:
        """Before which code points a piece must end, and after the last."""
        codes = self.pieces.codes(points)
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.pieces.beside[codes[:-1], codes[1:]] & ~((codes[:-1] == _LOW + 1) & (codes[1:] == _LOW + 1))
        return cut

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array and the bounds of each text in it."""
        out, ends, total = [np.empty(0, self.table.dtype)], [0], 0
        held: list[tuple[np.ndarray, bool]] = []

        def done() -> None:
            nonlocal total
            points = np.concatenate([p for p, _ in held])
            bounds = np.cumsum([0, *(len(p) for p, _ in held)])
            cut = self._borders(points)
            cut[bounds] = True
            edges = np.flatnonzero(cut) if len(points) else np.zeros(1, np.int64)
            starts, stops, raw = edges[:-1], edges[1:], points.view(np.uint8)
            hashes = hash_spans(raw, 4 * starts, 4 * stops, lower=False)
            ids, upto = self.table.expand(hashes, raw, 4 * starts, 4 * stops, lambda k: self._new(points, starts[k], stops[k]))
            upto = np.concatenate(([0], upto))[np.searchsorted(edges, bounds[1:])] + total
            ends.extend(u for u, (_, last) in zip(upto.tolist(), held) if last)
            out.append(ids)
            total += len(ids)
            held.clear()

        size = 0
        for part in self._parts(texts):
            held.append(part)
            size += len(part[0])
            if size >= PART:
                done()
                size = 0
        if held:
            done()
        return np.concatenate(out), np.array(ends, np.int64)

    def decode_flat(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of every text; vector operations over all ids at once."""
        sizes = self.pieces.sizes[ids]
        total = np.cumsum(sizes)
        index = np.arange(total[-1] if len(total) else 0) + np.repeat(self.pieces.offsets[ids] - total + sizes, sizes)
        raw = self.pieces.bytes[index].tobytes()
        at = np.concatenate(([0], total))[bounds].tolist()
        return [raw[a + 1: b] for a, b in zip(at[:-1], at[1:])]  # without the space put before

    def encode(self, text: str) -> list[int]:
        return self.flat([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        found = self.decode_flat(np.array(ids, np.int64), np.array([0, len(ids)]))
        return found[0].decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row of ``documents``."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            for piece in slices(batch):
                ids, bounds = coder.flat(piece.column("text").to_pylist())
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, ids array<int>")


def encoding_digests(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, score, round_trip`` of every row: a digest of the ids
    as little-endian 32-bit integers, their total score, and whether decoding the ids gives
    back the text."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column("text").to_pylist()
                ids, bounds = coder.flat(texts)
                same = [x == (t or "").encode() for x, t in zip(coder.decode_flat(ids, bounds), texts)]
                score = np.concatenate(([0.0], np.cumsum(coder.pieces.score[ids])))[bounds]
                wide = ids.astype("<u4")
                yield pa.record_batch({
                    "doc_id": piece.column("doc_id"), "n_tokens": pa.array(np.diff(bounds)),
                    "ids_crc32": pa.array([zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64()),
                    "score": pa.array(np.diff(score)), "round_trip": pa.array(same, pa.bool_())})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_crc32 long, score double, round_trip boolean")
