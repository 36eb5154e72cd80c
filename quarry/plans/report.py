"""Answers about a folder of packaged files, composed from sources and operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import constraints, lookups
from quarry.sources import files, tables


def probed(spark: SparkSession, inputs: list[str], max_bytes: int | None = None) -> DataFrame:
    """All files under the inputs with their kind.  Of every file the first 96 bytes are read;
    only archives and serialized files are then read whole, the others have a null content."""
    heads = files.prefixes(files.listed(spark, inputs))
    heads = heads.withColumn("p", files.probe(F.col("head"), F.col("length"))).select("path", "length", "p.kind", "p.serialized_version")
    if max_bytes is not None:
        heads = heads.where(F.col("length") <= max_bytes)
    wanted = F.col("kind").isin("archive", "serialized-file")
    content = files.read_listed(heads.where(wanted)).select("path", "content", "sha256")
    return heads.join(content, "path", "left")


def structure_report(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """Per serialized file, loose or in an archive: how many objects it has, how many ids
    are duplicate, how many payloads overlap, or why it was refused."""
    source = tables.sources(probed(spark, inputs))
    names = source.select("path", "member", F.decode("member_name", "UTF-8").alias("member_name"))
    checks = constraints.object_table_report(tables.objects_table(source))
    refused = tables.diagnostics(source).select("path", "member", "stage", F.col("status").alias("refusal"))
    report = names.join(checks, ["path", "member"], "left").join(refused, ["path", "member"], "left")
    return report.withColumn("accepted", F.col("refusal").isNull() & F.coalesce("accepted", F.lit(True)))


def accepted_sources(spark: SparkSession, inputs: list[str], registry: DataFrame | None = None) -> DataFrame:
    """The sources that the semantic view admits: sound tables, and a schema for every type,
    embedded or from the registry."""
    source = tables.sources(probed(spark, inputs))
    checks = constraints.object_table_report(tables.objects_table(source)).where("NOT accepted")
    refused = tables.diagnostics(source)
    good = source.join(checks, ["path", "member"], "left_anti").join(refused, ["path", "member"], "left_anti")
    entries = tables.schema_entries(good)
    if registry is None:
        lacking = entries.where("schema IS NULL").select("path", "member").distinct()
    else:
        lacking = lookups.resolved_sources(entries, registry).where("NOT resolved")
    return good.join(lacking, ["path", "member"], "left_anti")


def member_report(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """Counts of members by kind per archive."""
    opened = tables.members(probed(spark, inputs).where("kind = 'archive'"))
    return constraints.counts_by_kind(opened, "kind", ["serialized-file", "resource", "directory", "deleted", "invalid"], "path")


def visit_report(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """How a visit of each archive's members ends, with its counters."""
    opened = tables.members(probed(spark, inputs).where("kind = 'archive'"))
    return constraints.visit(opened, files.probe(F.col("data"))["kind"])
