"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

Each distinct shingle of a document gives one random value to one position of the
signature per step of a pseudorandom permutation; the value grows with the step.  The
steps are done level by level for all shingles of a block of documents at once, and a
document stops as soon as all its positions are filled: later steps can't lower any.  The
result equals the sequential form.

Documents with equal shingle sets are one class, and only classes go on.  Signatures are
cut into bands; classes that agree in a band meet in a bucket.  Buckets are resolved
without forming all their pairs.  First every member is compared with one centre, the
member that meets the most others through all its buckets, and links are grouped into
components.  Then, in each bucket, whatever is outside its largest component is compared
with every member of another component; pairs inside a component can't change the result.
Both steps together test every pair of a bucket that could join two components, so no link
between a bucket's members is lost whatever the bucket's size.  The second step works on
blocks of about ``OUTSIDE_BLOCK`` by ``MEMBER_BLOCK`` members, fewer where their sets are
large, which are dealt to all tasks in turn, counts
common shingles there with vector operations on 32-bit hashes, which can only overcount, and
gives out just the pairs that may be links.  A link counts only if the full sets of 64-bit
shingle hashes have 100 * intersection >= ``percent`` * union.

Edge cases: a text with fewer words than a shingle has its whole word sequence as its only
shingle; a null text or one without words has no shingles, n_shingles 0 and no links;
repeated rows are exact copies of each other; rows that share a doc_id are one node; a null
doc_id stays out of all groups, with component_id null and kept true; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import parts, whole
from .components import components
from .storage import cut
from .textvec import mix, pair, slices, words
from .workers import lean

POSITIONS, BAND_ROWS = 80, 4
WORDS, PERCENT = 5, 80
#: Members of an open bucket that meet in one piece of work, those outside and all, and how
#: many shingles either may have.
OUTSIDE_BLOCK, MEMBER_BLOCK, BLOCK_SHINGLES = 512, 512, 1 << 20
#: Parts that the members of an open bucket are dealt out in.
KEY_PARTS = 16
_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text in one array, and their bounds."""
    hashes, at = words(texts, lower=True)
    sets, bounds = [], np.zeros(len(at), np.int64)
    grams = hashes
    for k in range(1, size):
        grams = pair(grams[: len(hashes) - k], hashes[k:]) if len(hashes) > k else grams[:0]
    for i in range(len(at) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= size:
            own = np.unique(grams[a: b - size + 1])
        elif b > a:
            whole = hashes[a: a + 1]
            for k in range(a + 1, b):
                whole = pair(whole, hashes[k: k + 1])
            own = mix(whole + _U(b - a))
        else:
            own = hashes[:0]
        sets.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), bounds


def _draw(elements: np.ndarray, step: int, positions: int) -> tuple[np.ndarray, np.ndarray]:
    """For one step: an offset among the positions left, and the value step + uniform
    as an integer with 32 bits after the point."""
    h = mix(elements + _U((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    offset = ((h >> _U(32)) * _U(positions - step)) >> _U(32)
    return offset.astype(np.int64), (_U(step) << _U(32)) | (h & _U(0xFFFFFFFF))


def super_minhash(elements: np.ndarray, bounds: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """A row of ``positions`` values for each set; rows of empty sets stay at the maximum."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    out = np.full((n, positions), _EMPTY, np.uint64)
    row = np.repeat(np.arange(n), sizes)
    offset, value = _draw(elements, 0, positions)
    np.minimum.at(out.reshape(-1), row * positions + offset, value)
    open_rows = np.flatnonzero((sizes > 0) & (out == _EMPTY).any(axis=1))
    at = 0
    while at < len(open_rows):  # a bounded number of elements at a time
        to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[open_rows[at:]]), 100_000, side="right")) + at)
        some, at = open_rows[at:to], to
        which = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some])
        own, home = elements[which], np.repeat(some, sizes[some])
        order = np.tile(np.arange(positions, dtype=np.uint16), (len(own), 1))
        first = offset[which]
        line = np.arange(len(own))
        order[line, 0], order[line, first] = order[line, first], order[line, 0]
        for step in range(1, positions):
            offset_now, value_now = _draw(own, step, positions)
            pick = step + offset_now
            place = order[line[: len(own)], pick].astype(np.int64)
            order[line[: len(own)], pick] = order[:, step]
            order[:, step] = place
            np.minimum.at(out.reshape(-1), home * positions + place, value_now)
            still = (out[some] == _EMPTY).any(axis=1)
            if not still.any():
                break
            if not still.all():
                some = some[still]
                stay = np.isin(home, some)
                own, home, order = own[stay], home[stay], order[stay]
    return out


def bands(signatures: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, positions = signatures.shape
    keys = np.broadcast_to(mix(np.arange(positions // rows, dtype=np.uint64)), (n, positions // rows)).copy()
    for k in range(rows):
        keys = pair(keys, mix(signatures[:, k::rows][:, : positions // rows]))
    return keys.view(np.int64)


def sketches(documents: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, bands`` of every document; d1 and d2 are two
    order-free 64-bit digests of its shingle set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                elements, bounds = shingle_sets(piece.column("text"), size)
                n, none = np.diff(bounds), np.diff(bounds) == 0
                keys = bands(super_minhash(elements, bounds))
                digest = []
                for salt in (1, 2):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(elements ^ _U(salt)), dtype=np.uint64)))
                    digest.append(mix((total[bounds[1:]] - total[bounds[:-1]]) + n.astype(np.uint64)).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                yield pa.record_batch({
                    "doc_id": piece.column("doc_id"), "n_shingles": pa.array(n), "d1": pa.array(digest[0], mask=none),
                    "d2": pa.array(digest[1], mask=none), "bands": lists})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def set_table(documents: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``id, shingles, short`` of the documents in ``ids (id)``: their sorted 64-bit shingle
    hashes as bytes, and 32 bits of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                elements, bounds = shingle_sets(piece.column("text"), size)
                raw, short = elements.tobytes(), (elements >> _U(32)).astype("<u4").tobytes()
                yield pa.record_batch({
                    "id": piece.column("doc_id"), "shingles": pa.array([raw[8 * a: 8 * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                    "short": pa.array([short[4 * a: 4 * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    return rows.mapInArrow(lean(run), "id long, shingles binary, short binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate((p, q)), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
    two = one.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
    return two.mapInArrow(lean(run), "a long, b long")


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose set sizes allow the similarity."""
    sized = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _compare(part: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of one block, one side outside the largest component, that may be links."""
    ids, home = part.column("id").to_numpy(), part.column("component").to_numpy()
    left = part.column("side").to_numpy() == 0
    sets = [np.frombuffer(x.as_buffer(), "<u4") for x in part.column("short")]
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(a) or not len(b):
        return ids[:0], ids[:0]
    sizes = np.array([len(x) for x in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    held = np.concatenate([place[ends[i] - sizes[i]: ends[i]] for i in b])
    starts = np.cumsum(sizes[b]) - sizes[b]
    flag, out = np.zeros(place.max() + 1, np.int32), []
    for i in a:
        own = place[ends[i] - sizes[i]: ends[i]]
        flag[own] = 1
        common = np.add.reduceat(flag[held], starts)
        flag[own] = 0
        near = (100 * common >= percent * (sizes[i] + sizes[b] - common)) & (home[b] != home[i])
        out.append(np.stack((np.full(near.sum(), ids[i]), ids[b[near]])))
    return tuple(np.concatenate(out, axis=1))


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key, i and j; each run of equal ones is a block."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for x, y in zip(starts[:-1], starts[1:]):
            now = tuple(c[x] for c in columns) if y > x else last
            if held and now != last:
                yield from _found(held, percent)
                held = []
            held.append(batch.slice(x, y - x))
            last = now
    if held:
        yield from _found(held, percent)


def _found(held: list[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    part = pa.Table.from_batches(held).combine_chunks().to_batches()
    if part:
        a, b = _compare(part[0], percent)
        if len(a):
            yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def links(documents: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """``id, component`` of all classes ``id, n, bands`` that link with another class."""
    members = classes.select("id", "n", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    # Sizes after explode() are underestimated, so this join must not choose to broadcast.
    members = cut(members.join(sizes.hint("merge"), "key"), "bucket-members")
    reach = members.groupBy("id").agg(F.sum(F.col("k") - 1).alias("reach"))
    sets = cut(set_table(documents, reach.select("id"), size).dropDuplicates(["id"]), "shingle-sets")
    ranked = members.join(reach, "id")
    centres = ranked.groupBy("key").agg(F.max(F.struct("reach", (-F.col("id")).alias("minus"), "n")).alias("c"))
    centres = centres.select("key", (-F.col("c.minus")).alias("a"), F.col("c.n").alias("na"))
    first = members.join(centres, "key").select("a", "na", F.col("id").alias("b"), F.col("n").alias("nb"))
    found = cut(verified(_possible(first, percent), sets, percent), "centre-links")
    groups = components(found)

    # What a bucket has outside its largest component, against its other components.
    placed = members.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    shares = placed.groupBy("key", "component").agg(F.count("*").alias("share"), F.sum("n").alias("mass"))
    largest = shares.groupBy("key").agg(F.max(F.struct("share", "component", "mass")).alias("top"), F.count("*").alias("parts"), F.sum("share").alias("k"), F.sum("mass").alias("m"))
    n_i = F.ceil(F.greatest((F.col("k") - F.col("top.share")) / OUTSIDE_BLOCK, (F.col("m") - F.col("top.mass")) / BLOCK_SHINGLES))
    n_j = F.ceil(F.greatest(F.col("k") / MEMBER_BLOCK, F.col("m") / BLOCK_SHINGLES))
    largest = largest.where("parts > 1").select("key", F.col("top.component").alias("top"), n_i.alias("n_i"), n_j.alias("n_j"))
    # A bucket's members come in several parts, each with a copy of its row.
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(KEY_PARTS)).cast("int")
    copies = largest.withColumn("part", F.explode(F.array(*map(F.lit, range(KEY_PARTS)))))
    rows = placed.drop("k").withColumn("part", part).join(copies.hint("merge"), ["key", "part"]).drop("part")
    n_i, n_j = F.col("n_i"), F.col("n_j")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    mine = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n)
    cells = F.transform(upto(n_i), lambda i: F.struct(i.alias("i"), mine(n_j, 1).alias("j"), F.lit(1).alias("side")))
    extra = F.transform(upto(n_j), lambda j: F.struct(mine(n_i, 2).alias("i"), j.alias("j"), F.lit(0).alias("side")))
    cells = F.when(F.col("component") == F.col("top"), cells).otherwise(F.concat(cells, extra))
    rows = rows.withColumn("cell", F.explode(cells)).select("key", "cell.i", "cell.j", "cell.side", "id", "component", "n_j")
    # The blocks of a bucket go to one task after the other, as a hash would put several into one.
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.pmod(F.xxhash64("key") % tasks + F.col("i") * F.col("n_j") + F.col("j"), F.lit(tasks)).cast("int")
    rows = rows.join(sets.select("id", "short").hint("merge"), "id").withColumn("task", task).drop("n_j")
    rows = rows.repartitionById(tasks, "task").drop("task").sortWithinPartitions("key", "i", "j")
    maybe = rows.mapInArrow(lean(lambda batches: _blocks(batches, percent)), "a long, b long").distinct()
    more = cut(verified(maybe, sets, percent), "further-links")
    return components(found.unionByName(more))


def near_duplicates(documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``documents``."""
    rows = cut(sketches(documents, size), "sketches")
    full = rows.where("d1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    # Two classes may share their least doc_id; then either's bands lead to the one node.
    groups = links(documents, classes, size, percent)
    homes = classes.select("d1", "d2", "id").join(groups, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("home"))
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(homes, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("home", "doc_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def kept_documents(documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates, with its own columns: the one with
    the least doc_id, and of rows that share it the one whose text has the least hash.
    Rows without a doc_id all stay."""
    found = near_duplicates(documents, size, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("keep")).distinct()
    # The input's columns stay in one struct, so their names can't clash with those used here.
    row = whole(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text", row.cast("string")).alias("tie"), row.alias("row"))
    named = rows.join(found.hint("merge"), F.col("id") == F.col("keep"), "left_semi")
    one = named.groupBy("id").agg(F.min_by("row", "tie").alias("row")).select("row")
    both = one.unionByName(rows.where("id IS NULL").select("row"))
    return both.select(*parts(documents, "row"))
