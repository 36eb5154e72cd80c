"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is fitted with numpy from two bounded samples of the training rows:
confirmed toxic documents, and documents that nobody confirmed as toxic, which count as
unlabelled whatever their label.  The risk is class-prior-corrected: with prior ``p`` of
toxic documents among the unlabelled, the negative part is the unlabelled loss less ``p``
times the loss of the confirmed documents as negatives; where that falls below zero, which
only overfitting can do, the step goes the other way.

Features are hashed lower-case words and their first 5, 6 and 7 bytes, with the logarithm
of their density as value.  A screen keeps those whose mean differs between the samples by
``SCREEN`` standard errors.  Neither labels nor lang, source or doc_id are ever an input
of a score.

The samples are ids with the lowest hashes, ``POSITIVES`` and ``UNLABELLED`` in expectation,
with one text each (of an id's several, the one of the least hash); whole texts are read.  Only this fit is sampled; every
document is scored.

Edge cases: a null or empty text has no features and gets the intercept's score; a doc_id
with several labels is toxic if one says so; null labels count as none; repeated rows each
get their row; without labels or confirmed documents every score is the prior's; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import parts, schema, whole
from .textvec import buffer_of, hash_spans, mix, slices, word_spans
from .workers import lean

FOLDS = 5
POSITIVES, UNLABELLED = 2000, 4000
BITS, PREFIXES = 18, (None, 5, 6, 7)
SCREEN, RIDGE, STEPS, RATE = 3.0, 0.1, 200, 0.05
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each text's features, their ids and values; only ``wanted`` ids if given."""
    raw, bounds = buffer_of(texts)
    starts, ends = word_spans(raw)
    at = np.searchsorted(starts, bounds)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    keys = []
    for k, size in enumerate(PREFIXES):
        h = hash_spans(raw, starts, ends if size is None else np.minimum(ends, starts + size), lower=True)
        ids = (mix(h + np.uint64(7919 * k)) >> np.uint64(64 - BITS)).astype(np.int64)
        key = (row << BITS) | ids
        keys.append(key if wanted is None else key[wanted[ids]])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row = key >> BITS
    value = np.log1p(count * 200.0 / np.maximum(n[row], 50))
    return np.searchsorted(row, np.arange(len(n) + 1)), key & ((1 << BITS) - 1), value


@dataclass
class Linear:
    ids: np.ndarray
    weights: np.ndarray
    bias: float


class Sparse:
    """Rows of (id, value) in one array each, with the sums a gradient step needs."""

    CHUNK = 1 << 19

    def __init__(self, bounds: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.bounds, self.ids, self.values = bounds, ids, values
        self.n = len(bounds) - 1

    def _chunks(self) -> Iterator[slice]:
        for at in range(0, len(self.ids), self.CHUNK):
            yield slice(at, at + self.CHUNK)

    def moments(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        first, second = np.zeros(size), np.zeros(size)
        for part in self._chunks():
            values = self.values[part].astype(np.float64)
            first += np.bincount(self.ids[part], values, minlength=size)
            second += np.bincount(self.ids[part], values * values, minlength=size)
        mean = first / max(1, self.n)
        return mean, second / max(1, self.n) - mean ** 2

    def only(self, place: np.ndarray) -> Sparse:
        """The entries whose id has a place, under that place."""
        ids, values, keep = [], [], np.zeros(len(self.ids) + 1, np.int32)
        for part in self._chunks():
            to = place[self.ids[part]]
            ids.append(to[to >= 0])
            values.append(self.values[part][to >= 0])
            keep[1:][part] = to >= 0
        empty = [np.empty(0, np.int64)]
        return Sparse(np.cumsum(keep, dtype=np.int64)[self.bounds], np.concatenate(ids or empty), np.concatenate(values or empty).astype(np.float64))

    def times(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(weights[self.ids] * self.values)))[self.bounds]
        return np.diff(total)

    def back(self, by_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, np.repeat(by_row, np.diff(self.bounds)) * self.values, minlength=size)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def non_negative_pu(positive: Sparse, unlabelled: Sparse, prior: float, hidden: float) -> Linear:
    """Minimise ``prior * E+[loss(f, 1)] + max(0, E_u[loss(f, 0)] - hidden * E+[loss(f, 0)])``
    with logistic loss by full-batch Adam steps; ``hidden`` is the share of toxic documents
    in the unlabelled sample."""
    size = 1 << BITS
    bias = float(np.log(prior / (1 - prior)))
    if not positive.n or not unlabelled.n:
        return Linear(np.empty(0, np.int64), np.empty(0), bias)
    (mp, vp), (mu, vu) = positive.moments(size), unlabelled.moments(size)
    error = np.sqrt((vp + 1 / positive.n) / positive.n + (vu + 1 / unlabelled.n) / unlabelled.n)
    ids = np.flatnonzero(np.abs(mp - mu) > SCREEN * error)
    place = np.full(size, -1)
    place[ids] = np.arange(len(ids))
    xp, xu, k = positive.only(place), unlabelled.only(place), len(ids)
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = bias
    for step in range(1, STEPS + 1):
        zp, zu = xp.times(w[:k]) + w[k], xu.times(w[:k]) + w[k]
        negative = np.logaddexp(0, zu).mean() - hidden * np.logaddexp(0, zp).mean()
        pp, pu = _sigmoid(zp), _sigmoid(zu)
        if negative >= 0:
            gp, gu = (prior * (pp - 1) - hidden * pp) / xp.n, pu / xu.n
        else:
            gp, gu = hidden * pp / xp.n, -pu / xu.n
        g = np.append(xp.back(gp, k) + xu.back(gu, k) + RIDGE / xp.n * w[:k], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Linear(ids, w[:k], float(w[k]))


def _collect(rows: DataFrame) -> Sparse:
    """The features of a bounded sample of rows, on the driver."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                bounds, ids, values = features(piece.column("text"))
                to = pa.array(bounds.astype(np.int32))
                yield pa.record_batch({
                    "ids": pa.ListArray.from_arrays(to, pa.array(ids.astype(np.int32))),
                    "vals": pa.ListArray.from_arrays(to, pa.array(values.astype(np.float32)))})

    table = rows.select("text").mapInArrow(lean(extract), "ids array<int>, vals array<float>").toArrow()
    bounds, ids, values = [np.zeros(1, np.int64)], [], []
    for batch in table.to_batches():
        found = batch.column("ids")
        offsets = found.offsets.to_numpy().astype(np.int64)
        bounds.append(bounds[-1][-1] + offsets[1:] - offsets[0])
        ids.append(found.flatten().to_numpy())
        values.append(batch.column("vals").flatten().to_numpy())
    if not ids:
        return Sparse(np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.float32))
    return Sparse(np.concatenate(bounds), np.concatenate(ids), np.concatenate(values))


def train(documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Linear:
    """Fit on rows outside fold 0 of ``documents (doc_id, text)`` and ``labels (doc_id, toxic)``."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(fold(F.col("doc_id")) != 0)
    marks = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0)).alias("toxic")).first()
    n_docs = docs.select("doc_id").count()
    prior = min(0.99, max(0.001, seen["toxic"] / seen["n"] if seen["n"] else 0.01))
    rank = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30))
    lowest = lambda most, of: rank < int((1 << 30) * min(1.0, most / max(1, of)))
    # Ids first, texts then: both lists of ids are samples of bounded size.
    toxic = marks.where("toxic = 1").select("doc_id")
    sure = toxic.where(lowest(positives, seen["toxic"]))
    rest = docs.select("doc_id").where(lowest(unlabelled, n_docs)).distinct().join(toxic, "doc_id", "left_anti")
    # One text of each id, whatever the number of its rows.
    one = lambda ids: docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    xp, xu = _collect(one(sure)), _collect(one(rest))
    # Documents labelled as not toxic are part of the unlabelled sample and hide none.
    hidden = prior * max(0.0, n_docs - seen["n"]) / max(1, n_docs - seen["toxic"])
    return non_negative_pu(xp, xu, prior, hidden)


def score(documents: DataFrame, model: Linear, carry: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, and with ``carry`` also ``in_row``,
    all columns of ``documents`` in a struct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
        wanted[model.ids], weights[model.ids] = True, model.weights
        for batch in batches:
            for piece in slices(batch):
                bounds, ids, values = features(piece.column("text"), wanted)
                x = Sparse(bounds, ids, values)
                value = _sigmoid(x.times(weights) + model.bias)
                columns = {"doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"), "score": pa.array(value), "predicted": pa.array((value >= 0.5).astype(np.int32))}
                yield pa.record_batch(columns | ({"in_row": piece.column("in_row")} if carry else {}))

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"),
        *([whole(documents).alias("in_row")] if carry else []))
    return rows.mapInArrow(lean(run), schema(SCORED, documents if carry else None))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, train(documents, labels))


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that aren't predicted to be toxic, with their own columns."""
    return score(documents, train(documents, labels), carry=True).where("predicted = 0").select(*parts(documents, "in_row"))
