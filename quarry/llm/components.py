"""Connected components of a large graph by union-find and star contraction.

Every partition of edges first runs a union-find of its own and keeps a star per group,
which leaves at most one edge a node and partition.  Alternating large-star and small-star
steps then hang every node on the least id of its component; the number of steps grows
with the logarithm of the largest component.  Nothing is collected: the driver sees only
two numbers a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .workers import lean


#: Nodes that a task holds at a time.
MOST_HELD = 1 << 20


class UnionFind:
    """Disjoint sets whose root is the least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root and up != x:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low
            self.parent.setdefault(low, low)


def _forest(batches: Iterator[pa.RecordBatch], most: int = MOST_HELD) -> Iterator[pa.RecordBatch]:
    sets = UnionFind()

    def stars() -> Iterator[pa.RecordBatch]:
        pairs = [(a, b) for a, b in ((x, sets.find(x)) for x in sets.parent) if a != b]
        for at in range(0, len(pairs), 65536):
            some = pairs[at: at + 65536]
            yield pa.record_batch({"a": pa.array([x for x, _ in some], pa.int64()), "b": pa.array([y for _, y in some], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            sets.union(a, b)
        if len(sets.parent) > most:  # what later edges join to these, the steps below do
            yield from stars()
            sets = UnionFind()
    yield from stars()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id in the edges ``a, b``; component is its least id.
    An id that only has an edge to itself, or none, has no row: it is its own component."""
    e = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    e = cut(e.mapInArrow(lean(_forest), "a long, b long").distinct(), "forest")
    before = None
    while True:
        # Large star: every larger neighbour goes to the least id around.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "large-star")
        # Small star: an id and its smaller neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m")
        small = large.join(least, F.col("a") == F.col("of")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = e.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
