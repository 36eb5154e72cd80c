"""Near-duplicate vectors through a pivot-permutation index.

Reference points are a bounded sample of the vectors of each length, ``2 * sqrt(n)`` and
``MOST_PIVOTS`` at most: in the order of a hash, each class whose cosine with all before it
is below ``APART``, so that a large group of near vectors gets one and its members share it,
rather than draw from many about as near.  Every vector is described by its nearest reference
points, ``NEAREST`` and one more for each four-fold number of pivots beyond a thousand, and
indexed in the inverted list of each.  Two vectors meet if their count of shared pivots is one
or more, and a pair belongs to the list of its least shared pivot: where the count of shared
pivots below it is zero.

Lists are worked through in blocks of at most ``BLOCK`` by ``BLOCK`` vectors; longer lists
are dealt out as pairs of blocks.  First with vectors rounded to eight bits a component: each
carries the norm of what rounding took from it, so a bound of the cosine holds for certain
and only vectors with a partner that may be near enough go on.  Those meet again whole, and
links are decided by cosine in double precision.  A block gives out one count per vector and
the edges of a spanning forest of its links, never its pairs.  Equal vectors are one class with
a multiplicity.  The chance that a pair of cosine 0.9 in 64 dimensions shares a pivot was
measured as 1.00 with 45 pivots, 0.99 with 1,000 and 0.99 with 16,384; the tests measure it.
Beyond ``MOST_PIVOTS`` ** 2 / 4 vectors lists grow with their number, and blocks with them.

Edge cases: vectors that are null, zero, hold null or non-finite components link with nothing,
and no vector links with one of another length; labels are not used; equal vec_ids with equal
vectors are copies of each other; rows that share a vec_id are one node of the groups; a null
vec_id has a null component_id and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import components
from .storage import cut
from .workers import lean

THRESHOLD = 0.9
NEAREST, MOST_PIVOTS, BLOCK = 6, 1 << 14, 1024
#: Bytes that all pivots of a length may take.
PIVOT_BYTES = 64 << 20
APART, ROUNDS = 0.7, 4
_NONE = (1 << 16) - 1


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe for very large and small values."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def nearest_of(pivots: int) -> int:
    """How many nearest pivots describe a vector."""
    return NEAREST + max(0, math.ceil(math.log(max(1, pivots) / 1024, 4)))


def permutations(vectors: np.ndarray, pivots: np.ndarray, nearest: int | None = None) -> np.ndarray:
    """The ids of each unit vector's nearest pivots, nearest first."""
    near = vectors @ pivots.T
    n = min(nearest or nearest_of(len(pivots)), len(pivots))
    some = np.argpartition(-near, n - 1, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def _matrices(batch: pa.RecordBatch, most: int = 512) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch whose vectors have one length, and their vectors as they are."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        for at in range(0, len(rows), most):
            part = batch.take(pa.array(rows[at: at + most]))
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _clean(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v, dim, d1, d2`` with v null where the vector links with nothing."""
    kind = embeddings.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0.0)
    rows = rows.select("vec_id", F.when(good, F.col("v")).alias("v"))
    some = F.col("v").isNotNull()
    return rows.withColumns({"dim": F.when(some, F.size("v")), "d1": F.when(some, F.xxhash64("v")), "d2": F.when(some, F.xxhash64(F.lit(1), "v"))})


def _thin(vectors: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """``pivots`` and each of the unit vectors that is far from all of them and all before it."""
    held = np.concatenate((pivots, np.empty((max(0, most - len(pivots)), vectors.shape[1]))))
    n = len(pivots)
    for x in vectors:
        if n < most and (not n or (held[:n] @ x).max() < APART):
            held[n] = x
            n += 1
    return held[:n]


def _far(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The classes that are near none of the pivots of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch):
                own = pivots.get(x.shape[1], np.empty((0, x.shape[1])))
                if len(own):
                    part = part.filter(pa.array((unit(x.astype(np.float64)) @ own.T).max(axis=1) < APART))
                yield part

    return classes.mapInArrow(lean(run), classes.schema)


def choose_pivots(classes: DataFrame, most: int = MOST_PIVOTS) -> dict[int, np.ndarray]:
    """The pivots of each length, in rounds, each over the classes that are far from the pivots
    so far, so that large groups don't use up the sample; near ones only where there are fewer
    than ``NEAREST`` others."""
    classes = classes.select("id", "dim", "d1", "d2", "v")
    rank = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40))
    wanted: dict[int, int] = {}

    def sample(rows: DataFrame) -> dict[int, np.ndarray]:
        """Per length about twice as many as wanted of the lowest ranks, in their order."""
        sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).collect()
        if not wanted:
            limit = lambda dim: min(most, PIVOT_BYTES // (8 * dim))
            wanted.update({r["dim"]: max(NEAREST, min(limit(r["dim"]), math.ceil(2 * math.sqrt(r["n"])))) for r in sizes})
        if not sizes:
            return {}
        bound = [(r["dim"], int((1 << 40) * min(1.0, (2 * wanted[r["dim"]] + 64) / r["n"]))) for r in sizes]
        bounds = F.broadcast(rows.sparkSession.createDataFrame(bound, "of int, upto long"))
        some = rows.withColumn("rank", rank).join(bounds, F.col("dim") == F.col("of")).where(F.col("rank") < F.col("upto"))
        found: dict[int, list] = {}
        for r in sorted(some.select("dim", "rank", "d1", "d2", "v").collect(), key=lambda r: (r["rank"], r["d1"], r["d2"])):
            found.setdefault(r["dim"], []).append(r["v"])
        return {dim: unit(np.array(vs, np.float64)) for dim, vs in found.items()}

    first = sample(classes)
    pivots = {dim: _thin(x, x[:0], wanted[dim]) for dim, x in first.items()}
    for _ in range(ROUNDS):
        open_dims = [dim for dim in pivots if len(pivots[dim]) < wanted[dim]]
        if not open_dims or not (more := sample(_far(classes.where(F.col("dim").isin(open_dims)), pivots))):
            break
        for dim, x in more.items():
            pivots[dim] = _thin(x, pivots.get(dim, x[:0]), wanted[dim])
    for dim, x in first.items():
        if len(pivots[dim]) < NEAREST:
            new = [v for v in x if (pivots[dim] != v).any(axis=1).all()]
            pivots[dim] = np.array([*pivots[dim], *new][:NEAREST])
    return pivots


def _index(classes: DataFrame, pivots) -> DataFrame:
    """``id, dim, size, near, v``: each class with its nearest pivots, ascending, as bytes, and
    its vector as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch):
                near = np.sort(permutations(unit(x.astype(np.float64)), pivots.value[x.shape[1]]), axis=1).astype("<u2")
                lists, raw = near.tobytes(), np.ascontiguousarray(x).tobytes()
                w, d = 2 * near.shape[1], x.itemsize * x.shape[1]
                yield pa.record_batch({
                    **{c: part.column(c) for c in ("id", "dim", "size")}, "near": pa.array([lists[i: i + w] for i in range(0, len(lists), w)], pa.binary()),
                    "v": pa.array([raw[i: i + d] for i in range(0, len(raw), d)], pa.binary())})

    return classes.select("id", "dim", "size", "v").mapInArrow(lean(run), "id long, dim int, size long, near binary, v binary")


def _list_sizes(index: DataFrame) -> DataFrame:
    """``key, k``: how many classes each inverted list holds; a list's key is the vectors'
    length and the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"key": pa.array(np.concatenate([np.empty(0, np.int64), *(keys.ravel() for _, keys, _ in _lists(batch))]))})

    return index.select("dim", "near").mapInArrow(lean(run), "key long").groupBy("key").agg(F.count("*").alias("k"))


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the rows of a batch, the keys of their lists and their nearest pivots."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        near = np.frombuffer(b"".join(batch.column("near").take(pa.array(rows)).to_pylist()), "<u2").reshape(len(rows), -1)
        yield rows, (dim << 16) + near.astype(np.int64), near


def _record(dim: int, width: int) -> np.dtype:
    return np.dtype([("id", "<i8"), ("loss", "<f4"), ("scale", "<f4"), ("side", "u1"), ("near", "<u2", (width,)), ("q", "i1", (dim,))])


def _deal(index: DataFrame, parts, single: bool) -> DataFrame:
    """``key, cell, entry``: the rounded vectors, once for each block in which they take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of, parts_of = parts.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for rows, keys, near in _lists(batch):
                dim = int(keys[0, 0] >> 16)
                x = unit(np.frombuffer(b"".join(batch.column("v").take(pa.array(rows)).to_pylist()), "<f4" if single else "<f8").reshape(-1, dim).astype(np.float64))
                scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
                q = np.rint(x / scale[:, None]).astype(np.int8)
                entry = np.zeros(len(rows), _record(dim, near.shape[1]))
                entry["id"], entry["scale"], entry["near"], entry["q"] = ids[rows], scale, near, q
                # Rounded up, with room for the products in single precision.
                entry["loss"] = np.linalg.norm(x - q * scale[:, None].astype(np.float64), axis=1) * 1.0001 + 1e-5 * math.sqrt(dim)
                at = np.searchsorted(keys_of, keys.ravel())
                n = parts_of[at]  # 0 where a list holds no one else
                which = np.repeat(np.arange(len(at)), n)
                own = (_spread(ids[rows])[which // keys.shape[1]] % n[which].astype(np.uint64)).astype(np.int64)
                other = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                full = entry[which // keys.shape[1]]
                full["side"] = np.where(own == other, 2, np.where(own < other, 0, 1))
                raw, size = full.tobytes(), full.itemsize
                yield pa.record_batch({
                    "key": pa.array(keys.ravel()[which]), "cell": pa.array(np.minimum(own, other) << 32 | np.maximum(own, other)),
                    "entry": pa.array([raw[i: i + size] for i in range(0, len(raw), size)], pa.binary())})

    return index.select("id", "dim", "near", "v").mapInArrow(lean(run), "key long, cell long, entry binary")


def _spread(ids: np.ndarray) -> np.ndarray:
    from .textvec import mix

    return mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _foreign(near: np.ndarray, a: np.ndarray, b: np.ndarray, pivot: int) -> np.ndarray:
    """Which pairs share a pivot below this list's: they belong to another list."""
    who, which = np.nonzero(near < pivot)
    seen, which = np.unique(near[who, which], return_inverse=True)
    lower = np.zeros((len(near), len(seen)), np.float32)
    lower[who, which] = 1
    return lower[a] @ lower[b].T > 0


def _coarse(part: pa.RecordBatch, threshold: float) -> pa.RecordBatch | None:
    """The vectors of a block that may link with another one in it."""
    key, raw = int(part.column("key")[0].as_py()), part.column("entry").to_pylist()
    dim = key >> 16
    width = (len(raw[0]) - _record(dim, 0).itemsize) // 2
    rows = np.frombuffer(b"".join(raw), _record(dim, width))
    a, b = np.flatnonzero(rows["side"] != 1), np.flatnonzero(rows["side"] != 0)  # side 2: a block with itself
    x = rows["q"] * rows["scale"][:, None]
    loss = rows["loss"]
    may = x[a] @ x[b].T >= threshold - (loss[a][:, None] + loss[b][None, :] * (1 + loss[a][:, None]))
    may &= rows["id"][a][:, None] != rows["id"][b][None, :]
    if not may.any():
        return None
    may &= ~_foreign(rows["near"], a, b, key & _NONE)
    keep = np.zeros(len(rows), bool)
    keep[a[may.any(axis=1)]] = True
    keep[b[may.any(axis=0)]] = True
    keep = np.flatnonzero(keep)
    if not len(keep):
        return None
    some = part.take(pa.array(keep))
    return pa.record_batch({"key": some.column("key"), "cell": some.column("cell"), "side": pa.array(rows["side"][keep].astype(np.int32)), "id": pa.array(rows["id"][keep])})


def _verify(part: pa.RecordBatch, threshold: float, single: bool) -> pa.RecordBatch | None:
    """Counts and a spanning forest of the links of one block."""
    ids, size = part.column("id").to_numpy(), part.column("size").to_numpy()
    side = part.column("side").to_numpy()
    key = int(part.column("key")[0].as_py())
    x = unit(np.frombuffer(b"".join(part.column("v").to_pylist()), "<f4" if single else "<f8").reshape(len(ids), -1).astype(np.float64))
    a, b = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
    near = x[a] @ x[b].T >= threshold
    near &= ids[a][:, None] != ids[b][None, :]
    if not near.any():
        return None
    near &= ~_foreign(np.frombuffer(b"".join(part.column("near").to_pylist()), "<u2").reshape(len(ids), -1), a, b, key & _NONE)
    n = np.zeros(len(ids))
    n[a] += near @ size[b].astype(np.float64)
    if side[0] != 2:
        n[b] += size[a].astype(np.float64) @ near
    n = n.astype(np.int64)
    edges = []
    group = np.arange(len(b))  # of each column; a row joins all that it links with
    for row in np.flatnonzero(near.any(axis=1)).tolist():
        linked, first = np.unique(group[hits := np.flatnonzero(near[row])], return_index=True)
        own = group[row] if side[0] == 2 else linked[0]
        edges += [(ids[a[row]], ids[b[hits[k]]]) for k, g in zip(first.tolist(), linked.tolist()) if side[0] != 2 or g != own]
        if len(linked) > 1 or linked[0] != own:
            group[np.isin(group, linked)] = own
    hit = np.flatnonzero(n)
    return pa.record_batch({
        "a": pa.array(np.concatenate((ids[hit], np.array([e[0] for e in edges], np.int64)))),
        "b": pa.array([None] * len(hit) + [int(e[1]) for e in edges], pa.int64()),
        "n": pa.array(np.concatenate((n[hit], np.zeros(len(edges), np.int64))))})


def _by_block(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and cell; each run of equal ones is a block."""
    held: list[pa.RecordBatch] = []
    last = None

    def done() -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
        if part.num_rows > 1 and (out := work(part)) is not None:
            yield out

    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("key", "cell")]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for x, y in zip(starts[:-1], starts[1:]):
            if y == x:
                continue
            now = tuple(c[x] for c in columns)
            if held and now != last:
                yield from done()
                held = []
            held.append(batch.slice(x, y - x))
            last = now
    if held:
        yield from done()


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most: int = MOST_PIVOTS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``embeddings``."""
    context = embeddings.sparkSession.sparkContext
    rows = cut(_clean(embeddings), "vectors")
    single = rows.schema["v"].dataType.elementType == FloatType()
    good = rows.where("v IS NOT NULL AND vec_id IS NOT NULL")
    classes = good.groupBy("d1", "d2").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("v").alias("v"), F.first("dim").alias("dim"))
    classes = cut(classes, "vector-classes")
    pivots = context.broadcast(choose_pivots(classes, most))
    index = cut(_index(classes, pivots), "pivot-index")
    # A row for each pivot, whose number is bounded.
    sizes = _list_sizes(index).toArrow()
    order = np.argsort(sizes.column("key").to_numpy())
    k = sizes.column("k").to_numpy()[order]
    parts = context.broadcast((sizes.column("key").to_numpy()[order], np.where(k > 1, -(-k // block), 0)))
    by_block = lambda df: df.repartition("key", "cell").sortWithinPartitions("key", "cell")
    dealt = by_block(_deal(index, parts, single))
    may = dealt.mapInArrow(lean(lambda batches: _by_block(batches, lambda part: _coarse(part, threshold))), "key long, cell long, side int, id long")
    # Ids in a table of classes are distinct up to vectors that share their least vec_id.
    whole = by_block(cut(may, "may-link").join(index.select("id", "size", "near", "v").hint("merge"), "id"))
    found = whole.mapInArrow(lean(lambda batches: _by_block(batches, lambda part: _verify(part, threshold, single))), "a long, b long, n long")
    found = cut(found, "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    groups = components(found.where("b IS NOT NULL").select("a", "b"))
    homes = classes.select("d1", "d2", "id", "size").join(counts, "id", "left").join(groups, "id", "left")
    homes = homes.select("d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "id").alias("home"))
    out = rows.select("vec_id", "d1", "d2").join(homes, ["d1", "d2"], "left")
    out = out.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("home", "vec_id")))
    links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long")
    return out.select("vec_id", links.alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
