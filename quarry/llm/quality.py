"""Quality rules: word statistics and n-gram perplexity with bands per language.

The language model is a modified Kneser-Ney model over 5-grams of code points, each language
with its own.  Spark counts the 5-grams of all texts (four NULs stand before a text), and
derives continuation counts, discounts and back-off weights with joins and aggregates.  The
model is stored in the shared folder as sorted arrays of 64-bit hashes with log10
probabilities and back-off weights, a file for each language and range of hashes, so that no
task holds a language.  Workers map the files to memory, look up what a block of text has
that they haven't seen, and keep the values found in a direct-mapped table of fixed size.

A document's perplexity is 10 ** (-log10 probability of its text / its words): each word is
taken with the blanks after it, and blanks before the first word count as one.  Within each
language the bands are median +- ``spread`` robust standard deviations of log10(perplexity)
over all documents that pass the base rules, and never narrower than ``narrowest``.  As
perplexity varies most between short texts, the deviation is that of texts with the
document's standard error: its error times the language's robust standard deviation of
(log10(perplexity) - median) / error.  A document outside is rejected.

5-grams that occur fewer than ``least`` times (1: none) can be left out of the model; their
mass then goes to the back-off weight of their context, so that all sums stay one.

Edge cases: a null or empty text has no words, fails the base rules and has a null
perplexity; a null language is a language of its own; a word over ``PART`` characters may
count as several in the standard error; repeated rows count as often as they occur and each
gets its row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import parts, schema, whole
from .storage import cut, filesystem, map_file, shared_dir, write_file
from .textvec import SPACE, buffer_of, hash_spans, mix, pair, slices, word_spans
from .workers import lean

ORDER, BITS = 5, 21
SPREAD_HIGH, SPREAD_LOW, NARROWEST = 2.5, 2.5, 0.02
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
BIN = 0.0005
#: Of deviations in standard errors, and the most that is told apart.
ERROR_BIN, MOST_ERRORS = 0.005, 100.0
#: Languages up to which their bands are broadcast.
MOST_BROADCAST = 65_536
#: Characters taken at a time, entries of a file of the model, and places of a worker's table.
PART, SHARD_ENTRIES, TABLE_BITS = 1 << 19, 1 << 21, 20

_U = np.uint64
_ONE, _TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1
_BLANK = np.zeros(0x21, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


# A gram is two numbers: ``lo`` holds its last three code points, ``hi`` the two before.

def shorter(hi, lo, order: int):
    """The gram's last ``order`` code points."""
    return (hi & _ONE if order == 4 else hi * 0 if order < 4 else hi), (lo & _TWO if order == 2 else lo & _ONE if order == 1 else lo)


def gram_hash(hi: np.ndarray, lo: np.ndarray, order: int, weight: bool = False) -> np.ndarray:
    """The key of a gram's probability, or of its back-off weight as a context."""
    return mix(mix(lo.astype(np.uint64) + _U((2 * order + weight + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) ^ hi.astype(np.uint64))


class Block:
    """The 5-grams that end in each character of some texts or parts of texts."""

    def __init__(self, some: list[tuple[int, str, str]]):
        points = np.frombuffer("".join(["\0" * (ORDER - 1 - len(before)) + before + text for _, before, text in some]).encode("utf-32-le"), "<u4")
        lengths = np.fromiter((len(text) for _, _, text in some), np.int64, len(some))
        begins = np.cumsum(lengths + ORDER - 1) - lengths
        keep = np.ones(len(points), bool)
        keep[(begins[:, None] - np.arange(1, ORDER)[None, :]).ravel()] = False
        p, n = points.astype(np.uint64), len(points) - ORDER + 1
        keep = keep[ORDER - 1:]
        self.hi = (p[:n] << _U(BITS) | p[1: n + 1])[keep]
        self.lo = (p[2: n + 2] << _U(2 * BITS) | p[3: n + 3] << _U(BITS) | p[4:])[keep]
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))
        blank = np.zeros(len(points), bool)
        low = points < len(_BLANK)
        blank[low] = _BLANK[points[low]]
        fresh = blank[ORDER - 2: -1] & ~blank[ORDER - 1:]
        fresh = fresh[keep]
        fresh[self.bounds[:-1]] = True
        self.words = np.flatnonzero(fresh)
        self.word_bounds = np.searchsorted(self.words, self.bounds)
        self.rows = np.fromiter((row for row, _, _ in some), np.int64, len(some))


def blocks(piece: pa.RecordBatch) -> Iterator[tuple[str | None, Block]]:
    """The texts of a batch by language, a long text in parts."""
    langs, texts = piece.column("lang").to_pylist(), piece.column("text").to_pylist()
    held: dict[str | None, list[tuple[int, str, str]]] = {}
    size: dict[str | None, int] = {}
    for row, (lang, text) in enumerate(zip(langs, texts)):
        for at in range(0, len(text or ""), PART):
            held.setdefault(lang, []).append((row, text[max(0, at - ORDER + 1): at], text[at: at + PART]))
            size[lang] = size.get(lang, 0) + min(PART, len(text) - at)
            if size[lang] >= PART:
                yield lang, Block(held.pop(lang))
                size[lang] = 0
    for lang, some in held.items():
        yield lang, Block(some)


def count_grams(documents: DataFrame) -> DataFrame:
    """``lang, hi, lo, n`` over all characters of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, ...]]] = {}

        def merged(found):
            if len(found) == 1:
                return found[0]
            key = np.concatenate([f[0] for f in found])
            key, first, which = np.unique(key, return_index=True, return_inverse=True)
            hi, lo, n = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
            return key, hi[first], lo[first], np.bincount(which, n).astype(np.int64)

        def rows(lang, found) -> pa.RecordBatch:
            _, hi, lo, n = merged(found)
            return pa.record_batch({"lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), "hi": pa.array(hi.astype(np.int64)), "lo": pa.array(lo.astype(np.int64)), "n": pa.array(n)})

        for batch in batches:
            for piece in slices(batch):
                for lang, block in blocks(piece):
                    key, first, n = np.unique(gram_hash(block.hi, block.lo, ORDER), return_index=True, return_counts=True)
                    found = held.setdefault(lang, [])
                    found.append((key, block.hi[first], block.lo[first], n))
                    if sum(len(f[0]) for f in found[1:]) > max(1 << 18, len(found[0][0])):
                        held[lang] = [merged(found)]
                        if len(held[lang][0][0]) > PART or len(held) > 64:
                            yield rows(lang, held.pop(lang))
        for lang, found in held.items():
            yield rows(lang, found)

    rows = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(count), "lang string, hi long, lo long, n long").groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


def _same(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
    return a.join(b, [a[c].eqNullSafe(b[c]) for c in on]).drop(*(b[c] for c in on))


def kneser_ney(counts: DataFrame, least: int = 1) -> tuple[DataFrame, int]:
    """``lang, weight, gram_order, hi, lo, value`` of the model and a bound of their number:
    log10 of the interpolated probability of a gram's last code point, and where ``weight``
    the log10 back-off weight of a context."""
    short = lambda k: [x.alias(n) for x, n in zip(_shorter(k), ("hi", "lo"))]
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct code points before
        levels[k] = levels[k + 1].groupBy("lang", *short(k)).agg(F.count("*").alias("n"))
        if k > 1:
            levels[k] = cut(levels[k], f"kn-counts-{k}")
    lower, out, entries = None, [], 0
    for k in range(1, ORDER + 1):
        level = levels[k]
        seen = [F.sum(F.when(F.col("n") == i, 1.0).otherwise(0.0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        marks = level.groupBy("lang").agg(*seen, F.count("*").alias("types"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        guess = lambda i: F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))).otherwise(F.lit(0.5 * i))
        marks = cut(marks.select("lang", "types", *(F.least(F.greatest(guess(i), F.lit(0.05 * i)), F.lit(0.95 * i)).alias(f"d{i}") for i in (1, 2, 3))), f"kn-discounts-{k}")
        level = _per_language(level, marks).withColumns({"head_hi": F.shiftright("hi", BITS), "head_lo": F.shiftright("lo", BITS).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(F.lit(_ONE)), 2 * BITS))})
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        less = F.when(F.col("n") < least, F.col("n")).otherwise(less) if k == ORDER else less
        level = level.withColumn("less", F.least(less, F.col("n").cast("double")))
        heads = level.groupBy("lang", "head_hi", "head_lo").agg(F.sum("n").alias("total"), (F.sum("less") / F.sum("n")).alias("left"))
        if k == 1:  # what a language has never shown shares the mass left as one more code point
            heads = _per_language(heads, marks.select("lang", "types")).withColumn("left", F.col("left") / (F.col("types") + 1))
        heads = cut(heads.select("lang", "head_hi", "head_lo", "total", "left"), f"kn-heads-{k}")
        level = level.where(F.col("n") >= least) if k == ORDER else level
        level = _same(level, heads, "lang", "head_hi", "head_lo").withColumn("own", (F.col("n") - F.col("less")) / F.col("total"))
        if lower is None:
            level = level.withColumn("p", F.col("own") + F.col("left"))
        else:
            # Every suffix of a seen gram was counted at the order below, so this join loses none.
            below = lower.select("lang", F.col("hi").alias("below_hi"), F.col("lo").alias("below_lo"), F.col("p").alias("below"))
            level = level.withColumns(dict(zip(("below_hi", "below_lo"), _shorter(k - 1))))
            level = _same(level, below, "lang", "below_hi", "below_lo").withColumn("p", F.col("own") + F.col("left") * F.col("below"))
        lower = cut(level.select("lang", "hi", "lo", "p"), f"kn-{k}")
        entries += lower.count() + heads.count()
        out.append(lower.select("lang", F.lit(False).alias("weight"), F.lit(k).alias("gram_order"), "hi", "lo", F.log10("p").alias("value")))
        out.append(heads.select("lang", F.lit(True).alias("weight"), F.lit(k - 1).alias("gram_order"), F.col("head_hi").alias("hi"), F.col("head_lo").alias("lo"), F.log10("left").alias("value")))
    model = out[0]
    for x in out[1:]:
        model = model.unionByName(x)
    return model, entries


def _shorter(order: int):
    hi, lo, none = F.col("hi"), F.col("lo"), F.lit(0).cast("long")
    hi = hi.bitwiseAND(F.lit(_ONE)) if order == 4 else none if order < 4 else hi
    return hi, lo.bitwiseAND(F.lit(_TWO)) if order == 2 else lo.bitwiseAND(F.lit(_ONE)) if order == 1 else lo


def model_uri(path: str, lang: str | None, shard: int) -> str:
    return f"{path}/{'null' if lang is None else hashlib.sha256(lang.encode()).hexdigest()}-{shard:06d}.kn"


def write_models(model: DataFrame, entries: int, path: str) -> int:
    """A file for each language and range of hashes: sorted hashes and values.  Returns how
    many bits of a hash name its file."""
    bits = max(0, math.ceil(math.log2(max(1, entries) / SHARD_ENTRIES)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = batch.column("hi").to_numpy(), batch.column("lo").to_numpy()
            order, weight = batch.column("gram_order").to_numpy(), batch.column("weight").to_numpy(zero_copy_only=False)
            key = np.empty(len(hi), np.uint64)
            for k in range(ORDER + 1):
                for w in (False, True):
                    at = np.flatnonzero((order == k) & (weight == w))
                    key[at] = gram_hash(hi[at], lo[at], k, w)
            shard = key >> _U(64 - bits) if bits else key * _U(0)
            yield pa.record_batch({"lang": batch.column("lang"), "shard": pa.array(shard.astype(np.int32)), "key": pa.array(key.view(np.int64)), "value": pa.array(batch.column("value").to_numpy().astype(np.float32))})

    def write(group: tuple, table: pa.Table) -> pa.Table:
        key, value = table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()
        rank = np.argsort(key)
        fs, final = filesystem(uri := model_uri(path, group[0].as_py(), group[1].as_py()))
        if not fs.get_file_info(final).is_file:  # a repeated task would write the same
            write_file(uri, [np.array([len(key)], "<u8").tobytes(), key[rank].astype("<u8").tobytes(), value[rank].astype("<f4").tobytes()])
        return pa.table({"entries": pa.array([len(key)], pa.int64())})

    rows = model.mapInArrow(lean(keyed), "lang string, shard int, key long, value float")
    rows.groupBy("lang", "shard").applyInArrow(write, "entries long").write.parquet(f"{path}/written")
    return bits


class Model:
    """A language's model over its memory-mapped files, each opened when first needed."""

    def __init__(self, path: str, lang: str | None, bits: int):
        self.path, self.lang, self.bits = path, lang, bits
        self.files: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _file(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        if shard not in self.files:
            fs, final = filesystem(uri := model_uri(self.path, self.lang, shard))
            if fs.get_file_info(final).is_file:
                data = map_file(uri)
                n = int(np.frombuffer(data, "<u8", 1)[0])
                self.files[shard] = np.frombuffer(data, "<u8", n, 8), np.frombuffer(data, "<f4", n, 8 + 8 * n)
            else:
                self.files[shard] = np.empty(0, "<u8"), np.empty(0, "<f4")
        return self.files[shard]

    def find(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some keys, and which there are."""
        rank = np.argsort(want)
        ordered = want[rank]
        value, hit = np.zeros(len(want)), np.zeros(len(want), bool)
        shards = np.unique(ordered >> _U(64 - self.bits)).tolist() if self.bits else [0]
        for shard in shards:
            a, b = (np.searchsorted(ordered, _U(shard << 64 - self.bits)), np.searchsorted(ordered, _U((shard + 1 << 64 - self.bits) - 1), "right")) if self.bits else (0, len(want))
            keys, values = self._file(shard)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, ordered[a:b]), len(keys) - 1)
                hit[rank[a:b]] = keys[at] == ordered[a:b]
                value[rank[a:b]] = values[at]
        return value, hit

    def log10(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """log10 probability of the last code point of each 5-gram, backing off as needed."""
        out, rest, paid = np.empty(len(hi)), np.arange(len(hi)), np.zeros(len(hi))
        for order in range(ORDER, 0, -1):
            a, b = shorter(hi[rest], lo[rest], order)
            value, hit = self.find(gram_hash(a, b, order))
            out[rest[hit]] = value[hit] + paid[hit]
            miss = ~hit
            rest, a, b = rest[miss], a[miss], b[miss]
            weight, known = self.find(gram_hash(a >> _U(BITS), b >> _U(BITS) | (a & _U(_ONE)) << _U(2 * BITS), order - 1, True))
            paid = paid[miss] + np.where(known, weight, 0.0)
        out[rest] = paid
        return out


class Scores:
    """log10 probabilities of 5-grams, those last seen in a table of fixed size."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits
        self.models: dict[str | None, Model] = {}
        self.keys, self.values = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.float32)

    def log10(self, lang: str | None, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        if lang not in self.models:
            if len(self.models) >= 64:
                self.models.clear()
            self.models[lang] = Model(self.path, lang, self.bits)
        salt = int.from_bytes(hashlib.blake2b(b"n" if lang is None else b"s" + lang.encode(), digest_size=8).digest(), "little")
        key = gram_hash(hi, lo, ORDER) ^ _U(salt)
        place = (key >> _U(64 - TABLE_BITS)).astype(np.int64)
        out = self.values[place]
        miss = np.flatnonzero(self.keys[place] != key)
        if len(miss):
            _, first, which = np.unique(key[miss], return_index=True, return_inverse=True)
            first = miss[first]
            found = self.models[lang].log10(hi[first], lo[first]).astype(np.float32)
            out[miss] = found[which]
            self.keys[place[first]], self.values[place[first]] = key[first], found
        return out


def _repeat_words(hashes: np.ndarray) -> int:
    """Words covered by runs of WINDOW words that occur twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    run = hashes[:n]
    for k in range(1, WINDOW):
        run = pair(run, hashes[k: k + n])
    ranked = np.sort(run)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(run, twice))
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:-1])))


def word_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    raw, bounds = buffer_of(texts)
    starts, ends = word_spans(raw)
    at = np.searchsorted(starts, bounds)
    hashes = hash_spans(raw, starts, ends, lower=False)
    letter = ~SPACE[raw] & ((raw & 0xC0) != 0x80)  # the first byte of each code point of a word
    symbol = np.isin(raw, np.frombuffer(SYMBOLS.encode(), np.uint8))
    n = len(bounds) - 1
    per = lambda flags: np.add.reduceat(flags, bounds[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)  # noqa: E731  each text ends in a newline
    dup, repeat = np.zeros(n, np.int64), np.zeros(n, np.int64)
    texts = texts.to_pylist()
    for i in range(n):
        if at[i + 1] - at[i] > WINDOW:
            repeat[i] = _repeat_words(hashes[at[i]: at[i + 1]])
        if texts[i] and "\n" in texts[i]:
            lines = [x for x in texts[i].split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            dup[i] = len(lines) - len(set(lines))
    return {"n_words": np.diff(at), "word_chars": per(letter), "n_symbols": per(symbol), "n_dup_lines": dup, "n_repeat_words": repeat}


SCORED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, perplexity double, error double"


def _failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])


def statistics(documents: DataFrame) -> DataFrame:
    """``doc_id``, the word statistics and ``base_failed`` of every document, without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = word_statistics(piece.column("text"))
                yield pa.record_batch({"doc_id": piece.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in found.items()} | {"base_failed": pa.array(_failed(found))})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")


def score(documents: DataFrame, path: str, bits: int, carry: bool = False) -> DataFrame:
    """Word statistics, the base rules and the perplexity of every document; with ``carry``
    also ``in_row``, all columns of ``documents`` in a struct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(path, bits)
        for batch in batches:
            for piece in slices(batch):
                found = word_statistics(piece.column("text"))
                n, total, squares = (np.zeros(piece.num_rows) for _ in range(3))
                for lang, block in blocks(piece):
                    word = np.add.reduceat(scores.log10(lang, block.hi, block.lo), block.words, dtype=np.float64)
                    np.add.at(n, block.rows, np.diff(block.word_bounds))
                    np.add.at(total, block.rows, np.add.reduceat(word, block.word_bounds[:-1]))
                    np.add.at(squares, block.rows, np.add.reduceat(word * word, block.word_bounds[:-1]))
                none, n = n == 0, np.maximum(n, 1)
                mean = total / n
                error = np.sqrt(np.maximum(squares / n - mean * mean, 0) / n)
                failed = _failed(found)
                columns = {"doc_id": piece.column("doc_id"), "lang": piece.column("lang")} | {k: pa.array(v, pa.int64()) for k, v in found.items()}
                columns |= {"base_failed": pa.array(failed), "perplexity": pa.array(10.0 ** np.minimum(-mean, 300), mask=none), "error": pa.array(error, mask=none)}
                yield pa.record_batch(columns | ({"in_row": piece.column("in_row")} if carry else {}))

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        *([whole(documents).alias("in_row")] if carry else []))
    return rows.mapInArrow(lean(run), schema(SCORED, documents if carry else None))


def _per_language(rows: DataFrame, few: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``few``, a row for each language."""
    few = few.withColumnRenamed("lang", "of")
    if few.count() <= MOST_BROADCAST:  # a join by language would gather a common one
        few = F.broadcast(few)
    return rows.join(few, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")


def bands(scored: DataFrame) -> DataFrame:
    """``lang, centre, scale``: the median of log10(perplexity), and the robust standard deviation
    from it in standard errors; exact medians over histograms."""
    x = scored.where(~F.col("base_failed") & F.col("perplexity").isNotNull())

    def median(value, name: str, rows: DataFrame, width: float) -> DataFrame:
        # Tasks hand on a count for each bin, never the values.
        return rows.groupBy("lang").agg((F.percentile(F.round(value / width).cast("long"), 0.5) * width).alias(name))

    centre = cut(median(F.log10("perplexity"), "centre", x, BIN), "kn-centres")
    away = F.abs(F.log10("perplexity") - F.col("centre"))
    errors = F.when(F.col("error") > 0, F.least(away / F.col("error"), F.lit(MOST_ERRORS))).otherwise(F.lit(0.0))
    scale = median(errors, "scale", _per_language(x, centre), ERROR_BIN).withColumn("scale", F.col("scale") * 1.4826)
    return _per_language(centre, cut(scale, "kn-scales"))


def train(documents: DataFrame, least: int = 1) -> tuple[str, int]:
    """Count, estimate and store the models of all languages; returns their folder and how
    many bits of a hash name a file."""
    path = shared_dir(documents.sparkSession, "kneser-ney")
    return path, write_models(*kneser_ney(cut(count_grams(documents), "kn-counts"), least), path)


def judged(documents: DataFrame, carry: bool = False, high: float = SPREAD_HIGH, low: float = SPREAD_LOW, narrowest: float = NARROWEST, least: int = 1) -> DataFrame:
    """All columns of ``score`` with ``centre`` and ``scale`` of the language, and ``kept``."""
    scored = cut(score(documents, *train(documents, least), carry), "kn-scores")
    found = _per_language(scored, cut(bands(scored), "kn-bands"))
    away, spread = F.log10("perplexity") - F.col("centre"), F.col("scale") * F.col("error")
    banded = away.between(-F.greatest(spread * low, F.lit(narrowest)), F.greatest(spread * high, F.lit(narrowest)))
    inside = F.col("perplexity").isNotNull() & F.coalesce(banded, F.lit(True))
    return found.withColumn("kept", ~F.col("base_failed") & inside)


def quality(documents: DataFrame) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``kept`` and ``perplexity``."""
    return judged(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are kept, with their own columns."""
    return judged(documents, carry=True).where("kept").select(*parts(documents, "in_row"))
