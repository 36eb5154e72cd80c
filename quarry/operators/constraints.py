"""Constraints over decoded tables: uniqueness, overlap, totals, counts and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with ``n``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def overlaps(rows: DataFrame, within: list[str], start: str, size: str) -> DataFrame:
    """Rows whose range starts before the end of an earlier one in order of start and end;
    empty ranges are left out.  ``previous_end`` is where that one ends."""
    end = F.col(start) + F.col(size)
    order = Window.partitionBy(*within).orderBy(F.col(start), end).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.where(F.col(size) > 0).withColumn("previous_end", F.max(end).over(order))
    return found.where(F.col("previous_end") > F.col(start))


def running_total_violations(rows: DataFrame, within: list[str], order: str, amount: str, most: int) -> DataFrame:
    """Per group, the first row at which a running total passes ``most``, and the total there."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    over = rows.withColumn("total", F.sum(amount).over(w)).where(F.col("total") > most)
    return over.groupBy(*within).agg(F.min_by(F.struct(F.col(order).alias("row"), "total"), order).alias("first")).select(*within, "first.row", "first.total")


def object_table_report(objects: DataFrame) -> DataFrame:
    """``path, member, n_objects, duplicate_ids, overlapping, accepted`` of every source that
    has objects: ids must be unique and payloads must not overlap."""
    keys = ["path", "member"]
    twice = duplicates(objects, *keys, "path_id").groupBy(*keys).agg(F.count("*").alias("duplicate_ids"))
    over = overlaps(objects, keys, "rel_offset", "byte_size").groupBy(*keys).agg(F.count("*").alias("overlapping"))
    report = objects.groupBy(*keys).agg(F.count("*").alias("n_objects")).join(twice, keys, "left").join(over, keys, "left")
    report = report.fillna(0, ["duplicate_ids", "overlapping"])
    return report.withColumn("accepted", (F.col("duplicate_ids") == 0) & (F.col("overlapping") == 0))


def block_coverage(archives: DataFrame, blocks: DataFrame, region: Column) -> DataFrame:
    """Whether the compressed sizes of an archive's blocks add up to its data region exactly;
    ``payload`` is the sum of the others."""
    sums = blocks.groupBy("path").agg(F.sum("csize").alias("compressed"), F.sum("usize").alias("payload"))
    found = archives.join(sums, "path", "left").fillna(0, ["compressed", "payload"])
    return found.select("path", "compressed", "payload", (F.col("compressed") == region).alias("covered"))


def counts_by_kind(rows: DataFrame, kind: str, kinds: list[str], *keys: str) -> DataFrame:
    """One count per kind, as the counters of a visit."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(kind) == k).alias(k.replace("-", "_")) for k in kinds))


def visit(members: DataFrame, kind_of_data: Column) -> DataFrame:
    """Per archive how a visit of its members ends, and its counters up to there.

    It stops at the first member that isn't sound: directories and deleted members must be
    empty, and a serialized file must be one by its own bytes (``kind_of_data``, from a probe).
    A member that stops the visit counts if it is a directory or deleted.
    """
    kind, empty = F.col("kind"), F.col("size") == 0
    status = (
        F.when(kind == "resource", "ok").when(kind.isin("directory", "deleted"), F.when(empty, "ok").otherwise("member-invalid"))
        .when((kind != "serialized-file") | empty, "member-invalid").when(kind_of_data == "serialized-file", "ok")
        .when(kind_of_data.startswith("unsupported"), "unsupported").otherwise("member-invalid"))
    rows = members.select("path", "ordinal", "kind", status.alias("status"))
    first = rows.where("status <> 'ok'").groupBy("path").agg(F.min_by("status", "ordinal").alias("refusal"), F.min("ordinal").alias("stop"))
    rows = rows.join(first, "path", "left").where("stop IS NULL OR ordinal <= stop")
    before = F.col("stop").isNull() | (F.col("ordinal") < F.col("stop"))
    return rows.groupBy("path").agg(
        F.coalesce(F.first("refusal"), F.lit("ok")).alias("status"), F.count_if((kind == "serialized-file") & before).alias("serialized_files"),
        F.count_if((kind == "resource") & before).alias("resource_members"), F.count_if(kind == "directory").alias("directory_members"), F.count_if(kind == "deleted").alias("deleted_members"))


def exactly_one(rows: DataFrame, wanted: Column, *keys: str) -> DataFrame:
    """Per group whether the wanted row is missing, duplicate or there once, and its first ordinal."""
    found = rows.groupBy(*keys).agg(F.count_if(wanted).alias("n"), F.min(F.when(wanted, F.col("ordinal"))).alias("ordinal"))
    return found.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "duplicate").otherwise("ok"))


def merge_paths(*results: DataFrame) -> DataFrame:
    """The union of discovery results; a path is explicit if one of them says so."""
    union = results[0]
    for other in results[1:]:
        union = union.unionByName(other)
    return union.groupBy("path").agg(F.bool_or("explicit_file").alias("explicit_file"))


def member_class(flags: Column, name: Column) -> Column:
    """What an archive member is, from its flags and name, as a native expression."""
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    serialized, directory, deleted = has(4), has(1), has(2)
    resource = name.endswith(".resS") | name.endswith(".resource") | name.endswith(".resources")
    return (
        F.when(flags.bitwiseAND(F.lit(~7)) != 0, "invalid")
        .when(serialized, F.when(directory | deleted, "invalid").otherwise("serialized-file"))
        .when(directory, F.when(deleted, "invalid").otherwise("directory"))
        .when(deleted, "deleted")
        .when(resource, "resource")
        .otherwise("invalid"))
