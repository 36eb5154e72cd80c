"""Trees from preorder levels: the hierarchy rule, links and traversal contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINKS = "parent int, first_child int, next_sibling int, child_count int, subtree_end int"


def hierarchy_errors(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes that break the rule: level 0 first, then from 1 to one more than the one before."""
    order = Window.partitionBy(*keys).orderBy("ordinal")
    before = F.lag("level").over(order)
    wrong = F.when(before.isNull(), F.col("level") != 0).otherwise((F.col("level") < 1) | (F.col("level") > before + 1))
    return nodes.withColumn("wrong", wrong).where("wrong").drop("wrong")


def links(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Parent, first child, next sibling, child count and subtree end of every node, beside all
    its columns.

    A linear pass over each tree in order.  Trees are spread by their keys; a tree is a
    schema, whose size the format bounds.
    """
    rows = nodes.repartition(*keys).sortWithinPartitions(*keys, "ordinal")
    names = [x.split()[0] for x in LINKS.split(", ")]

    def finish(table: pa.Table, starts: list[int]) -> pa.RecordBatch:
        """Whole trees, each from its start to the next one's."""
        levels = table.column("level").to_pylist()
        n = len(levels)
        parent, first, following, count, end = [None] * n, [None] * n, [None] * n, [0] * n, [0] * n
        for low, high in zip(starts, [*starts[1:], n]):
            path: list[int] = []
            last: dict[int, int] = {}
            for k in range(low, high):
                for closed in path[levels[k]:]:
                    end[closed] = k - low
                del path[levels[k]:]
                if path:
                    up = path[-1]
                    parent[k] = up - low
                    count[up] += 1
                    if up in last:
                        following[last[up]] = k - low
                    else:
                        first[up] = k - low
                    last[up] = k
                path.append(k)
            for closed in path:
                end[closed] = high - low
        for name, column in zip(names, (parent, first, following, count, end)):
            table = table.append_column(name, pa.array(column, pa.int32()))
        return table.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            starts = _starts(held, keys)
            if len(starts) > 1:  # the last tree may go on
                yield finish(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None:
            yield finish(held, [0])

    return rows.mapInArrow(run, T.StructType([*nodes.schema.fields, *T.StructType.fromDDL(LINKS).fields]))


def _starts(table: pa.Table, keys: list[str]) -> list[int]:
    """Where the key of sorted rows changes."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change).tolist()


def links_by_join(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The same links defined relationally, in the form that SQL can state."""
    n = nodes.select(*keys, "ordinal", "level")
    a, b = n.alias("a"), n.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = lambda *more: _all([*same, *more])
    up = a.join(b, on(F.col("b.ordinal") < F.col("a.ordinal"), F.col("b.level") == F.col("a.level") - 1), "left")
    up = up.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.ordinal").alias("ordinal"), F.col("a.level").alias("level")).agg(F.max("b.ordinal").alias("parent"))
    down = a.join(b, on(F.col("b.ordinal") > F.col("a.ordinal"), F.col("b.level") <= F.col("a.level")), "left")
    down = down.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.ordinal").alias("ordinal")).agg(F.min("b.ordinal").alias("end"))
    sizes = n.groupBy(*keys).agg(F.count("*").alias("size"))
    out = up.join(down, [*keys, "ordinal"]).join(sizes, keys)
    siblings = Window.partitionBy(*keys, "parent").orderBy("ordinal")
    out = out.withColumns({"next_sibling": F.when(F.col("parent").isNotNull(), F.lead("ordinal").over(siblings)), "subtree_end": F.coalesce("end", F.col("size"))})
    kids = out.where("parent IS NOT NULL").groupBy(*keys, F.col("parent").alias("ordinal")).agg(F.min("ordinal").alias("first_child"), F.count("*").alias("child_count"))
    out = out.drop("end", "size").join(kids, [*keys, "ordinal"], "left").fillna(0, ["child_count"])
    return out


def _all(conditions):
    found = conditions[0]
    for c in conditions[1:]:
        found = found & c
    return found


def contexts(linked: DataFrame, keys: list[str]) -> DataFrame:
    """Per tree how far a traversal goes: ``registry`` is the one node flagged 0x04, which must
    be the last direct child of the root; a selected reference payload stops before it."""
    flagged = F.col("type_flags").bitwiseAND(F.lit(4)) != 0
    wrong_flags = flagged & (F.col("type_flags") != 4)
    wrong_place = flagged & ((F.col("parent") != 0) | F.col("parent").isNull() | F.col("next_sibling").isNotNull())
    found = linked.groupBy(*keys).agg(
        F.bool_or(wrong_flags).alias("bad_flags"), F.bool_or(wrong_place).alias("bad_place"), F.count_if(flagged).alias("n"),
        F.min(F.when(flagged, F.col("ordinal"))).alias("registry"), F.min(F.when(flagged, F.col("subtree_end"))).alias("stop"), F.max("subtree_end").alias("size"))
    found = found.withColumn("bad_place", F.col("bad_place") | F.coalesce(F.col("stop") != F.col("size"), F.lit(False)))
    status = F.when(F.col("bad_flags"), "unsupported-registry-flags").when(F.col("bad_place") | (F.col("n") > 1), "unsupported-registry-position").otherwise("ok")
    ok = F.col("status") == "ok"
    found = found.withColumn("status", status)
    return found.select(
        *keys, "status", F.when(ok, F.col("registry")).alias("registry"), F.when(ok, F.col("size")).alias("ordinary_end"),
        F.when(ok, F.coalesce("registry", "size")).alias("selected_end"))
