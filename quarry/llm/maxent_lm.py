"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased words and an end token per document.  A token's probability is the
product of the choices that lead to it through nested classes: the first classes are groups
of languages and bands of frequency, the last hold two words, and each choice is a softmax
over the two halves of a class, so that a word costs about as many choices as it has bits.

* Counts.  Spark counts all training tokens.  Words with a count of at least ``T`` form the
  head, where ``T`` >= 2 is the least bound that leaves ``HEAD`` words or fewer, so the head
  may be broadcast.  Head words are ordered by the language group in which they are most
  frequent and by count, and a class is cut where its halves have the most equal mass.  The
  end token is a head word; everything else, seen or not, shares one place, the tail.
* A choice has a bias, the logarithm of the halves' ratio of counts, and a weight for each of
  the context's hashed features: the n-grams w1 and w1 w2 of the words before, and the skips
  w2 and w1 _ w3.  The weights lie in one table of at least ``PER_TOKEN`` slots for each
  training token, up to ``2 ** MOST_BITS``; those of nearby choices lie side by side.
* Training.  In each of ``ROUNDS`` rounds over as many parts of the training documents, every
  task computes its gradient and curvature with the weights so far, other tasks add them up by
  ranges of slots, and each slot takes a damped step.  A task writes what it has touched to a
  file in the shared folder, which is deleted after the round (a shuffle's files would stay);
  the weights of a round, in 16 bits, are a file there that workers map to memory.
* In the tail, a word of count c has (c - d) / N_t of the tail's probability, and what the
  discount d frees, d * V_t / N_t, is that of the one unknown token, so all sums are one.
* Scoring is one pass in numpy over blocks of tokens: a word's path is a few rows, one for each
  neighbourhood, of ``NEARBY`` choices each, the last ones padded with choices that are certain.
  Rows are fetched whole, and the weights of their choices looked up sparsely.  Tail words are
  scored by a join with the counts.

Words are told apart by 64-bit hashes; among V distinct ones V**2 / 2**65 pairs are expected
to share one.

Edge cases: a null or empty text is one end token; a null doc_id counts as the empty text
in the fold; a null language is a group; repeated rows count and are scored each; without
training tokens all tokens are unknown; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_table import ranges
from .storage import cut, map_file, read_range, remove, shared_dir, write_file
from .textvec import mix, slices, words
from .workers import lean

FOLDS = 10
HEAD, GROUPS = 1 << 17, 8
#: The place of the tail in the order of words.
TAIL = 0
DISCOUNT = 0.5
PER_TOKEN, LEAST_BITS, MOST_BITS = 4, 16, 24
#: Slots that are added up together, and choices on a path whose weights lie side by side.
RANGE_BITS, NEARBY = 14, 4
#: Where the choices of a neighbourhood lie, from the top: those of the third level each before
#: the two that follow them, so that a path touches fewer cache lines.
ORDER = np.array([0, 1, 2, 3, 6, 9, 12, 4, 5, 7, 8, 10, 11, 13, 14], np.uint32)
#: The sign bit of a number of 32 bits, and the bias of a choice that is none.
FLIP, CERTAIN = np.int32(-1 << 31), np.float32(1e30)
#: Where the bits of a half lie in a number of 32 bits, and what that number is too small by.
HALF, HALF_SCALE = np.int32(0x8FFFE000 - (1 << 32)), np.float32(2.0 ** 112)
ROUNDS, RIDGE, MOST_STEP = 3, 0.3, 2.0
FEATURES = 4
#: Tokens of a block, and of a task in a round of training; beyond the cores, a task takes more.
BLOCK, TASK_TOKENS = 8192, 1 << 22
#: The largest sum that a task sends in 16 bits as it is.
MOST_SENT = 1 << 15
#: The hash of the end token; no word's hash is made this way.
END_HASH = int(np.uint64(0x454E444F46444F43).view(np.int64))
HELD_ROWS = 1 << 20
_U = np.uint64


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with the end tokens, and the bounds of each text."""
    hashes, at = words(texts, lower=True)
    out = np.empty(len(hashes) + len(at) - 1, np.int64)
    bounds = at + np.arange(len(at))
    last = np.zeros(len(out), bool)
    last[bounds[1:] - 1] = True
    out[last] = END_HASH
    out[~last] = hashes.view(np.int64)
    return out, bounds


def _fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def _rows(documents: DataFrame) -> DataFrame:
    group = (F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit("")).cast("binary")) % GROUPS).cast("int")
    fold = _fold().cast("int")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), (fold == 0).alias("held_out"), group.alias("g"), F.col("text").cast("string").alias("text"))


def count_tokens(documents: DataFrame) -> DataFrame:
    """``h, c, g``: the count of every training token and the language group it is most frequent in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            h = np.concatenate([p[0] for p in parts])
            n = np.concatenate([p[1] for p in parts])
            keys, which = np.unique(h, return_inverse=True)
            return keys, np.bincount(which, n, minlength=len(keys)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for g, parts in held.items():
                h, n = merged(parts)
                yield pa.record_batch({"h": pa.array(h), "g": pa.array(np.full(len(h), g, np.int32)), "n": pa.array(n)})
            held.clear()

        for batch in batches:
            for piece in slices(batch):
                tokens, bounds = _tokens(piece.column("text"))
                group = np.repeat(piece.column("g").to_numpy(), np.diff(bounds))
                for g in np.unique(group).tolist():
                    part = np.unique(tokens[group == g], return_counts=True)
                    held.setdefault(g, []).append(part)
                    size += len(part[0])
            if size > 4 * HELD_ROWS:
                for g in held:
                    held[g] = [merged(held[g])]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD_ROWS:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = _rows(documents).where("NOT held_out").select("g", "text").mapInArrow(lean(run), "h long, g int, n long")
    by_group = [F.sum(F.when(F.col("g") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(GROUPS)]
    best = F.greatest(*(F.struct(F.col(f"n{k}").alias("n"), F.lit(k).alias("g")) for k in range(GROUPS)))
    return rows.groupBy("h").agg(F.sum("n").alias("c"), *by_group).select("h", "c", best["g"].alias("g"))


@dataclass
class Vocabulary:
    """The head in order of hash with each word's place, the choices that lead to each place,
    and the sums of all tokens and of the tail."""

    hashes: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    first: np.ndarray  # of each place, its first row among the following; one more at the end
    key: np.ndarray  # of each row, the key of its neighbourhood
    rows: np.ndarray  # and its choices, as ``laid_out`` has them
    least: int
    n: int
    v: int
    tail_n: int
    tail_v: int

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index in the head, and whether a token is in it."""
        if not len(self.hashes):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return at, self.hashes[at] == tokens


def choices(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """``first, key, near, sign, bias`` of a vocabulary whose places have these counts: all
    classes of one depth are cut at a time."""
    total = np.concatenate(([0.0], np.cumsum(counts)))
    low, high = np.array([0]), np.array([len(counts)])
    low, high = low[high > 1], high[high > 1]
    key, near, n = _U(1) + np.zeros(len(low), _U), np.zeros(len(low), np.uint32), 0
    depth, found = 0, []
    while len(low):
        half = (total[low] + total[high]) / 2
        cut_at = np.clip(np.searchsorted(total, half), low + 1, high - 1)
        lower = np.maximum(cut_at - 1, low + 1)
        cut_at = np.where(np.abs(total[lower] - half) < np.abs(total[cut_at] - half), lower, cut_at)
        bias = np.log((total[high] - total[cut_at]) / (total[cut_at] - total[low]))
        size = high - low
        place = ranges(low, size)
        sign = np.where(place >= np.repeat(cut_at, size), 1, -1).astype(np.float32)
        found.append((place, np.repeat((key >> _U(32)).astype(np.uint32), size), np.repeat(ORDER[near], size), sign, np.repeat(bias, size).astype(np.float32) * sign))
        depth += 1
        low, high = np.stack((low, cut_at), 1).ravel(), np.stack((cut_at, high), 1).ravel()
        if depth % NEARBY:
            key, near = np.repeat(key, 2), np.stack((2 * near + 1, 2 * near + 2), 1).ravel()
        else:
            key, near = mix(n + np.arange(1, len(low) + 1, dtype=np.uint64) + (_U(depth) << _U(40))), np.zeros(len(low), np.uint32)
        more = high - low > 1
        low, high, key, near = low[more], high[more], key[more], near[more]
    if not found:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.float32), np.zeros(0, np.float32))]
    columns = [np.concatenate(x) for x in zip(*found)]
    rank = np.argsort(columns[0], kind="stable")
    return np.searchsorted(columns[0][rank], np.arange(len(counts) + 1)), *(x[rank] for x in columns[1:])


def laid_out(first: np.ndarray, key: np.ndarray, near: np.ndarray, sign: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first, key, rows`` of paths: a row holds the biases of ``NEARBY`` choices and then, as
    bits, their places in the neighbourhood, with ``FLIP`` set where the sign is negative."""
    n = np.diff(first)
    parts = -(-n // NEARBY)
    begin = np.repeat(first[:-1], parts) + NEARBY * ranges(np.zeros(len(n), np.int64), parts)
    end = np.repeat(first[1:], parts)
    rows = np.zeros((len(begin), 2 * NEARBY), np.float32)
    rows[:, :NEARBY] = CERTAIN
    code = rows.view(np.int32)
    for k in range(NEARBY):
        some = np.flatnonzero(begin + k < end)
        at = begin[some] + k
        rows[some, k] = bias[at]
        code[some, NEARBY + k] = near[at].astype(np.int32) | np.where(sign[at] < 0, FLIP, np.int32(0))
    return np.concatenate(([0], np.cumsum(parts))), key[begin], rows


def vocabulary(counts: DataFrame, most: int = HEAD) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The least bound from a histogram with a fixed number of bins.
    fine = 16
    bins = counts.where("c > 1").groupBy(F.floor(F.log2("c") * fine).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()
    room, least = most, None
    for row in sorted(bins, key=lambda r: -r["bin"]):
        room -= row["n"]
        if room < 0:
            break
        least = row["low"]
    least = least if least is not None else (1 << 62)
    if room >= 0:
        least = 2
    head = counts.where((F.col("c") >= least) | (F.col("h") == END_HASH)).toArrow()
    h = head.column("h").to_numpy()
    order = np.argsort(h, kind="stable")
    h, c, g = h[order], head.column("c").to_numpy()[order], head.column("g").to_numpy()[order]
    tail_n, tail_v = total["n"] - int(c.sum()), total["v"] - len(h)
    ranked = np.lexsort((h, -c, g))
    places = np.empty(len(h), np.int64)
    places[ranked] = np.arange(1, len(h) + 1)
    paths = choices(np.concatenate(([max(1, tail_n)], c[ranked])).astype(np.float64))
    return Vocabulary(h, c, places, *laid_out(*paths), int(least), int(total["n"]), int(total["v"]), tail_n, tail_v)


def features(places: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The hashed features of each token's context, from all places of some texts; before a
    text stands a place of its own."""
    inside = np.arange(len(places)) - np.repeat(bounds[:-1], np.diff(bounds))
    before = []
    for back in (1, 2, 3):
        w = np.zeros(len(places), np.uint64)
        w[back:] = places[: max(0, len(places) - back)] + 1
        w[inside < back] = 0
        before.append(w)
    w1, w2, w3 = before
    keys = [w1, w1 | w2 << _U(20), w2, w1 | w3 << _U(20)]
    return [(mix(k + (_U(i + 1) << _U(50))) >> _U(32)).astype(np.uint32) for i, k in enumerate(keys)]


def taken(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The weights at these slots in 32 bits; finite halves are widened by their bits, which
    takes less than numpy's conversion of one after the other."""
    found = np.take(weights, at, mode="clip")
    if found.dtype != np.float16:
        return found
    bits = found.view(np.int16).astype(np.int32)
    bits <<= 13
    bits &= HALF
    wide = bits.view(np.float32)
    wide *= HALF_SCALE
    return wide


def walk(v: Vocabulary, weights: np.ndarray | None, bits: int, places: np.ndarray, feats: list[np.ndarray], sums: np.ndarray | None = None) -> np.ndarray | None:
    """Natural log probability of each place in its context, or with ``sums``, adds the gradient
    (real part) and curvature (imaginary part) of every slot to them instead.  No weights are
    weights of zero."""
    first = v.first[places]
    n = v.first[places + 1] - first
    if not len(n) or not n.any():  # one place only; otherwise each has a choice
        return np.zeros(len(n))
    at, row, mask = ranges(first, n), np.repeat(np.arange(len(n)), n), (1 << bits) - 1
    key, found = np.take(v.key, at, mode="clip"), np.take(v.rows, at, axis=0, mode="clip")
    code = found[:, NEARBY:].view(np.int32)
    near, flip = code.ravel().astype(np.int64), code & FLIP  # the mask clears a sign bit of slots
    slots, x = [], np.zeros(code.shape, np.float32)
    for f in feats:
        # A context's hash is made once for all choices of a neighbourhood.
        h = np.take(f, row, mode="clip")
        h ^= key
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h >>= np.uint32(32 - bits)
        h = np.repeat(h.astype(np.int64), NEARBY)
        h += near
        h &= mask
        if sums is not None:
            slots.append(h)
        if weights is not None:
            x += taken(weights, h).reshape(x.shape)
    x.view(np.int32)[...] ^= flip
    x += found[:, :NEARBY]
    less = np.minimum(x, 0)
    one = 1 + np.exp(-np.abs(x))
    if sums is not None:
        other = np.exp(less - x) / one  # the probability of the other half
        step = np.empty(x.shape, np.complex64)
        step.imag = other * (1 - other)
        other.view(np.int32)[...] ^= flip
        step.real = other
        for h in slots:
            np.add.at(sums, h, step.ravel())
        return None
    # Factors of a row are at most two each, so one logarithm does.
    logs = -np.log(np.multiply.reduce([one[:, k] for k in range(NEARBY)]))
    for k in range(NEARBY):
        logs += less[:, k]
    return np.add.reduceat(logs, np.cumsum(n) - n, dtype=np.float64)


def table_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, PER_TOKEN * n)))))


ENCODED = "rid long, doc_id long, fold int, held_out boolean, ids array<int>, known long, base double, tail array<long>"


def encode(documents: DataFrame, head, packed: bool = False) -> DataFrame:
    """Of each document the places of its tokens, the base sums over its head tokens, and the
    list of its others.  With ``packed``, places are bytes of four each, which Spark stores and
    passes on whole and not number by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v: Vocabulary = head.value
        own = np.log10(v.counts + 0.1) - math.log10(v.n + 0.1 * (v.v + 1)) if len(v.hashes) else np.zeros(1)
        places = v.places if len(v.hashes) else np.zeros(1, np.int64)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in slices(batch):
                tokens, bounds = _tokens(piece.column("text"))
                distinct, which = np.unique(tokens, return_inverse=True)
                at, hit = v.find(distinct)
                ids, base, hit = np.where(hit, places[at], TAIL)[which], np.where(hit, own[at], 0.0)[which], hit[which]
                sums = lambda x: np.add.reduceat(x, bounds[:-1]) if len(x) else np.zeros(0)
                rest, n = np.flatnonzero(~hit), piece.num_rows
                lists = lambda to, x: pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(x))
                held = lists(bounds, ids.astype("<i4"))
                if packed:
                    held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * bounds).astype(np.int32)), held.values.buffers()[1]])
                yield pa.record_batch({
                    "rid": pa.array(rid + np.arange(n)), **{c: piece.column(c) for c in ("doc_id", "fold", "held_out")}, "ids": held,
                    "known": pa.array(sums(hit.astype(np.int64)).astype(np.int64)), "base": pa.array(sums(base)), "tail": lists(np.searchsorted(rest, bounds), tokens[rest])})
                rid += n

    return _rows(documents).select("doc_id", "fold", "held_out", "text").mapInArrow(lean(run), ENCODED.replace("array<int>", "binary") if packed else ENCODED)


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the places of each text start, one more for the end, and the places of all, from
    lists or bytes."""
    if pa.types.is_list(column.type):
        return column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.int32)
    wide = column.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset: wide.offset + len(wide) + 1] // 4
    return at, np.frombuffer(data, "<i4", int(at[-1]))


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """The place in the column of the first text, places and bounds of about ``BLOCK`` tokens
    of whole texts or a part of a long one, and their features."""
    offsets, ids = _places(column)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        some, bounds = ids[offsets[row]: offsets[to]].astype(np.int64), offsets[row: to + 1] - offsets[row]
        feats = features(some, bounds)
        if to > row + 1 or len(some) <= 2 * BLOCK:
            yield row, some, bounds, feats
        else:
            for at in range(0, len(some), BLOCK):
                yield row, some[at: at + BLOCK], np.array([0, min(BLOCK, len(some) - at)]), [f[at: at + BLOCK] for f in feats]
        row = to


def read_weights(uri: str) -> np.ndarray:
    """The weights by slot, memory-mapped where the file system is local."""
    return np.frombuffer(map_file(uri), "<f2")


def training_tasks(n: int, rounds: int, cores: int) -> int:
    """A task sends the slots it has touched, 64 MB at most, so it takes as many tokens as make
    that worth it; all cores take part from there on."""
    return max(1, min(cores, -(-n // (max(1, rounds) * TASK_TOKENS))))


def pack(part: np.ndarray) -> bytes:
    """The sums of a range of slots: which are touched, a scale, and gradients and curvatures
    in 16 bits under it, so that those of frequent contexts stay finite; nothing if none is."""
    hit = part.imag > 0
    if not hit.any():
        return b""
    g, h = part.real[hit], part.imag[hit]
    scale = max(1.0, float(max(np.abs(g).max(), h.max())) / MOST_SENT)
    return np.packbits(hit).tobytes() + np.float64(scale).astype("<f8").tobytes() + (g / scale).astype("<f2").tobytes() + (h / scale).astype("<f2").tobytes()


def add_packed(data: bytes, g: np.ndarray, h: np.ndarray) -> None:
    if not len(data):
        return
    bits = -(-len(g) // 8)
    hit = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, bits), count=len(g)))
    scale = np.frombuffer(data, "<f8", 1, bits)[0]
    g[hit] += np.frombuffer(data, "<f2", len(hit), bits + 8) * scale
    h[hit] += np.frombuffer(data, "<f2", len(hit), bits + 8 + 2 * len(hit)) * scale


def train(encoded: DataFrame, v: Vocabulary, head, rounds: int = ROUNDS) -> tuple[str, int]:
    """The file of weights by slot, and how many bits a slot has."""
    spark = encoded.sparkSession
    cores = spark.sparkContext.defaultParallelism
    bits = table_bits(v.n)
    span = 1 << min(RANGE_BITS, bits)
    weights, folder = np.zeros(1 << bits, np.float16), shared_dir(spark, "maxent")
    for k in range(rounds):
        now = f"{folder}/{k}.weights" if weights.any() else None  # all are zero at first
        if now:
            write_file(now, [weights.astype("<f2").tobytes()])

        def gradient(batches: Iterator[pa.RecordBatch], now=now, to=f"{folder}/{k}.sums") -> Iterator[pa.RecordBatch]:
            sums, table, any_rows = np.zeros(1 << bits, np.complex64), read_weights(now) if now else None, False
            for batch in batches:
                for _, some, _, feats in _blocks(batch.column("ids")):
                    walk(head.value, table, bits, some, feats, sums)
                    any_rows = True
            if not any_rows:
                return
            ends = [0]

            def ranges_of() -> Iterator[bytes]:
                for at in range(0, 1 << bits, span):
                    data = pack(sums[at: at + span])
                    ends.append(ends[-1] + len(data))
                    yield data

            # Only files that a task has returned count, so a repeated task does no harm.
            write_file(uri := f"{to}/{uuid.uuid4().hex}", ranges_of())
            yield pa.record_batch({"uri": pa.array([uri]), "ends": pa.array([ends], pa.list_(pa.int64()))})

        tasks = training_tasks(v.n, rounds, cores)
        part = encoded.where((F.col("fold") != 0) & (F.col("fold") % rounds == k)).select("ids").coalesce(tasks)
        # One row a task, with an offset for each range.
        files = part.mapInArrow(lean(gradient), "uri string, ends array<long>").collect()
        sent = [(row["uri"], np.array(row["ends"])) for row in files]

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j in batch.column("id").to_pylist():
                    g, h = np.zeros(span), np.zeros(span)
                    for uri, ends in sent:
                        add_packed(read_range(uri, int(ends[j]), int(ends[j + 1] - ends[j])), g, h)
                    move = np.clip(g / (FEATURES * (h + RIDGE)), -MOST_STEP, MOST_STEP).astype("<f2")
                    yield pa.record_batch({"at": pa.array([j * span], pa.int64()), "move": pa.array([move.tobytes()], pa.binary())})

        if sent:
            each = spark.range(0, (1 << bits) // span, 1, cores)
            # 2 ** MOST_BITS steps at most reach the driver.
            moves = each.mapInArrow(lean(step), "at long, move binary").toArrow()
            for at, move in zip(moves.column("at").to_pylist(), moves.column("move")):
                weights[at: at + span] += np.frombuffer(move.as_buffer(), "<f2")
            remove(spark, f"{folder}/{k}.sums")
        if now:
            remove(spark, now)
    write_file(last := f"{folder}/{rounds}.weights", [weights.astype("<f2").tobytes()])
    return last, bits


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"


def _score(encoded: DataFrame, head, weights: str, bits: int) -> DataFrame:
    """One row per document with the log10 probability of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_weights(weights)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for row, some, bounds, feats in _blocks(batch.column("ids")):
                logs = walk(head.value, table, bits, some, feats)
                score[row: row + len(bounds) - 1] += np.add.reduceat(logs, bounds[:-1]) / math.log(10)
            n = np.diff(_places(batch.column("ids"))[0])
            kept = {c: batch.column(c) for c in ("rid", "doc_id", "held_out", "known", "base")}
            yield pa.record_batch([kept["rid"], kept["doc_id"], kept["held_out"], pa.array(n), kept["known"], kept["base"], pa.array(score)], names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score"])

    return encoded.select("rid", "doc_id", "held_out", "ids", "known", "base").mapInArrow(lean(run), SCORED)


def score_documents(documents: DataFrame, most: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    counts = cut(count_tokens(documents), "token-counts")
    found = vocabulary(counts, most)
    head = documents.sparkSession.sparkContext.broadcast(found)
    encoded = cut(encode(documents, head, packed=True), "encoded")
    weights, bits = train(encoded, found, head, rounds)
    return _with_tail(cut(_score(encoded, head, weights, bits), "head-scores"), encoded, counts, found)


def base_scores(documents: DataFrame, most: int = HEAD) -> DataFrame:
    """The same columns but ``score``, without a model."""
    counts = cut(count_tokens(documents), "token-counts")
    found = vocabulary(counts, most)
    encoded = encode(documents, documents.sparkSession.sparkContext.broadcast(found))
    docs = encoded.select("rid", "doc_id", "held_out", F.size("ids").cast("long").alias("n_tokens"), "known", "base", F.lit(0.0).alias("score"), "tail")
    docs = cut(docs, "head-scores")
    return _with_tail(docs.drop("tail"), docs, counts, found).drop("score")


def _with_tail(docs: DataFrame, tails: DataFrame, counts: DataFrame, found: Vocabulary) -> DataFrame:
    """Documents with the sums over their tail words added to those over their head."""
    tail = tails.select("rid", F.explode("tail").alias("h"))
    rare = counts.where((F.col("c") < found.least) & (F.col("h") != END_HASH)).select("h", "c")
    seen = tail.join(rare.hint("merge"), "h", "left")
    z = math.log10(found.n + 0.1 * (found.v + 1))
    unknown = math.log10(DISCOUNT * found.tail_v / found.tail_n) if found.tail_n and found.tail_v else 0.0
    inside = F.when(F.col("c").isNotNull(), F.log10((F.col("c") - DISCOUNT) / float(max(1, found.tail_n)))).otherwise(F.lit(unknown))
    sums = seen.groupBy("rid").agg(
        F.count("c").alias("more"), F.sum(F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.1) - F.lit(z)).alias("tail_base"), F.sum(inside).alias("tail_score"))
    out = docs.join(sums.hint("merge"), "rid", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(found.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("tail_score", zero)).alias("score"))
