"""Lookups: exact keys, first matches, and references that are missing, unique or ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.decode.registry import KEY

FIELDS = "file_version class_id type_id script_index has_script_hash is_stripped is_ref script_hash type_hash".split()


def first_match(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the row that comes first in the order of the bytes."""
    row = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(*keys).agg(F.min_by(row, order).alias("row")).select("row.*")


def objects_with_type(objects: DataFrame, types: DataFrame) -> DataFrame:
    """Every object with its type row's class and script index, by ordinal."""
    wanted = types.select("path", "member", F.col("ordinal").alias("type_ordinal"), "class_id", "script_index")
    return objects.join(wanted, ["path", "member", "type_ordinal"])


def member_by_name(members: DataFrame, name: str) -> DataFrame:
    """Per archive the one member of a name, or why there is none: missing or duplicate."""
    wanted = F.col("name") == F.lit(name.encode())
    found = members.groupBy("path").agg(F.count_if(wanted).alias("n"), F.min(F.when(wanted, F.col("ordinal"))).alias("ordinal"))
    status = F.when(F.col("n") == 1, "ok").when(F.col("n") == 0, "missing").otherwise("duplicate")
    return found.select("path", status.alias("status"), F.when(F.col("n") == 1, F.col("ordinal")).alias("ordinal"))


def trichotomy(probes: DataFrame, targets: DataFrame, on: list[str], ordinal: str) -> DataFrame:
    """Every distinct probe key with ``outcome`` missing, unique or ambiguous, ``match_count``,
    and the first and second target ordinals.  Keys match byte for byte, null never.

    Targets are summed per key before the join, so no key's matches meet in one row.
    """
    seen = targets.groupBy(*on).agg(F.count("*").alias("match_count"), F.min(ordinal).alias("first"))
    later = targets.join(seen.select(*on, "first"), on).where(F.col(ordinal) > F.col("first"))
    second = later.groupBy(*on).agg(F.min(ordinal).alias("second"))
    found = probes.select(*on).distinct().join(seen, on, "left").join(second, on, "left")
    count = F.coalesce("match_count", F.lit(0))
    outcome = F.when(count == 0, "missing").when(count == 1, "unique").otherwise("ambiguous")
    return found.select(*on, outcome.alias("outcome"), count.alias("match_count"), "first", "second")


def identities_available(ref_types: DataFrame) -> DataFrame:
    """Per source whether its reference types carry names: a tail without trees doesn't."""
    return ref_types.groupBy("path", "member").agg(F.bool_and(F.col("class_name").isNotNull()).alias("available"))


def resolve_rids(slots: DataFrame, rows: DataFrame) -> DataFrame:
    """Every RID slot against the registry rows of its own host: missing, unique, ambiguous,
    or null if its one match is a null row."""
    host = ["path", "member", "object_ordinal"]
    matches = rows.groupBy(*host, "rid").agg(
        F.count("*").alias("match_count"), F.min("ordinal").alias("first_row"), F.min_by("kind", "ordinal").alias("kind"))
    second = rows.join(matches.select(*host, "rid", "first_row"), [*host, "rid"]).where("ordinal > first_row").groupBy(*host, "rid").agg(F.min("ordinal").alias("second_row"))
    found = slots.join(matches, [*host, "rid"], "left").join(second, [*host, "rid"], "left")
    count = F.coalesce("match_count", F.lit(0))
    resolution = F.when(count == 0, "missing").when(count > 1, "ambiguous").when(F.col("kind") == "null", "null").otherwise("unique")
    return found.select(*slots.columns, resolution.alias("resolution"), count.alias("match_count"), "first_row", "second_row")


def rid_totals(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("path", "member", "object_ordinal").agg(
        F.count("*").alias("slots"), F.count_if(F.col("resolution") == "missing").alias("missing"), F.count_if(F.col("resolution") == "ambiguous").alias("ambiguous"))


def strings_of(tables: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, and ``offset, text`` of every string of the NUL-separated ``strings``: where it
    starts, from a running sum of the lengths before."""
    parts = tables.select(*keys, F.posexplode(F.split(F.decode("strings", "ISO-8859-1"), "\\x00")).alias("at", "text"))
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({"offset": F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"), "last": F.max("at").over(Window.partitionBy(*keys))})
    return placed.where("at < last").select(*keys, "offset", "text")  # what follows the last NUL isn't terminated


def resolve_strings(offsets: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Names by exact start offset: ``offsets`` has the keys and ``offset``, ``tables`` the keys
    and ``strings``.  ``text`` is null where no string starts."""
    return offsets.join(strings_of(tables, keys), [*keys, "offset"], "left")


# Schema registry

def _same_key(a: DataFrame, b: DataFrame, fields) -> Column:
    on = None
    for k in fields:
        one = a[k].eqNullSafe(b[k])
        on = one if on is None else on & one
    return on


def schema_lookup(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Types without an embedded schema, with the schema of the registry entry that equals them
    in all ten key fields; ``found`` is null-safe.  No part of a key matches alone."""
    known = registry.select(*KEY, F.col("schema").alias("found_schema"))
    wanted = entries.where("schema IS NULL")
    joined = wanted.join(known, _same_key(wanted, known, KEY), "left")
    return joined.select(*(wanted[c] for c in wanted.columns if c != "schema"), "found_schema", F.col("found_schema").isNotNull().alias("found"))


def resolved_sources(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Per source whether every type has a schema, embedded or found: all or nothing."""
    looked = schema_lookup(entries, registry)
    return looked.groupBy("path", "member").agg(F.bool_and("found").alias("resolved"), F.count_if(~F.col("found")).alias("missing"))


def resolve_class(entries: DataFrame, registry: DataFrame, class_id: int) -> DataFrame:
    """Schemas for the unresolved rows of one class only, if all of them are found; embedded
    ones stay as they are."""
    looked = schema_lookup(entries.where(F.col("class_id") == class_id), registry)
    gate = looked.groupBy("path", "member").agg(F.bool_and("found").alias("all_found"))
    found = looked.join(gate, ["path", "member"]).where("all_found").select("path", "member", "row_kind", "type_ordinal", "found_schema")
    out = entries.join(found, ["path", "member", "row_kind", "type_ordinal"], "left")
    return out.withColumn("schema", F.coalesce("schema", "found_schema")).drop("found_schema")


def learn(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """What a registry becomes by sources' embedded schemas: the same key and schema again is
    no change; a source with a key of another schema is refused whole.

    ``key columns, schema, status`` with status known, learnt or conflict.  Sources that
    disagree with each other are all refused, as their order isn't given.
    """
    embedded = entries.where("schema IS NOT NULL")
    offers = embedded.select("path", "member", *KEY, "schema", F.lit(False).alias("known"))
    kept = registry.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("member"), *KEY, "schema", F.lit(True).alias("known"))
    union = offers.unionByName(kept)
    verdict = union.groupBy(*KEY).agg(
        (F.min("schema") != F.max("schema")).alias("conflict"), F.max(F.when(F.col("known"), F.col("schema"))).alias("known_schema"))
    judged = offers.join(verdict.withColumnsRenamed({k: f"v_{k}" for k in KEY}), _renamed_key(offers))
    against = F.col("conflict") & (F.col("known_schema").isNull() | (F.col("schema") != F.col("known_schema")))
    bad = judged.where(against).select("path", "member").distinct()
    good = offers.join(bad, ["path", "member"], "left_anti")
    out = registry.select(*KEY, "schema", F.lit("known").alias("status")).unionByName(good.select(*KEY, "schema", F.lit("learnt").alias("status")))
    out = out.groupBy(*KEY, "schema").agg(F.min("status").alias("status"))
    return out.unionByName(judged.join(bad, ["path", "member"], "left_semi").where(against).select(*KEY, "schema", F.lit("conflict").alias("status")).distinct())


def _renamed_key(a: DataFrame) -> Column:
    on = None
    for k in KEY:
        one = a[k].eqNullSafe(F.col(f"v_{k}"))
        on = one if on is None else on & one
    return on


def bind_version(registry: DataFrame, wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """For keys of another engine version: ``status`` ok, not-found, key-conflict or
    invalid-schema, and the schema to enter.

    A key that is there already is ok.  Else all entries that equal it but for the engine
    must have one schema, and ``profiles (engine, class_id, type_hash, shape_digest)`` must
    know that shape for the wanted engine.  ``registry`` needs ``shape_digest``.
    """
    here = registry.select(*KEY, F.lit(True).alias("exact"))
    want = wanted.select(*KEY)
    step = want.join(here, _same_key(want, here, KEY), "left").select(*(want[k] for k in KEY), "exact")
    others = registry.groupBy(*FIELDS).agg(F.min("schema").alias("schema"), (F.min("schema") != F.max("schema")).alias("differs"), F.min("shape_digest").alias("shape_digest"))
    step = step.join(others, _same_key(step, others, FIELDS), "left").select(*(step[c] for c in step.columns), "schema", "differs", F.col("shape_digest").alias("have"))
    known = profiles.select(F.col("engine").alias("p_engine"), F.col("class_id").alias("p_class"), F.col("type_hash").alias("p_hash"), F.col("shape_digest").alias("p_digest"))
    step = step.join(known, (F.col("engine") == F.col("p_engine")) & (F.col("class_id") == F.col("p_class")) & (F.col("type_hash") == F.col("p_hash")), "left")
    status = (
        F.when(F.col("exact"), "ok").when(F.col("schema").isNull(), "not-found").when(F.col("differs"), "key-conflict")
        .when(F.col("p_digest") == F.col("have"), "ok").otherwise("invalid-schema"))
    return step.select(*KEY, status.alias("status"), F.when((status == "ok") & F.col("exact").isNull(), F.col("schema")).alias("schema"))
