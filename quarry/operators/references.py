"""Resolving typed object references across files.

A pointer ``(file_id, path_id)`` of a source file leads to an object of the same file, or
through the file's externals to another one: an archive member of the same archive, or a
loose file found by its locator in the nearest directory on the way from the source's to the
scope root.  Everything but path text is joins: externals by ordinal, candidates by
normalised path, objects by first match.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import paths

from .lookups import first_match

ARCHIVE = "archive:/"
ZERO_GUID = bytes(16)
# The two built-in libraries as files name them, the guid that they must have
# with type 0, and where they lie.
BUILTIN = {
    "Resources/unity_builtin_extra": (bytes(8) + b"\x0f" + bytes(7), "Resources/unity_builtin_extra"),
    "Library/unity default resources": (bytes(8) + b"\x0e" + bytes(7), "Resources/unity default resources"),
}
SUCCESS = ("local", "external-exact", "external-builtin-contract")


def archive_locator(virtual: str | None, name: str | None) -> str | None:
    """The member path that an external names by archive URIs; two must agree."""
    if virtual is None or name is None:
        return None
    in_virtual, in_name = virtual.startswith(ARCHIVE), name.startswith(ARCHIVE)
    outer = virtual[len(ARCHIVE):] if in_virtual else ""
    inner = name[len(ARCHIVE):] if in_name else name
    if not outer:
        found = inner
    elif in_name:
        found = paths.normalize(outer) if paths.normalize(outer) == paths.normalize(inner) else None
    else:
        found = f"{outer}/{inner}" if inner else None
    found = paths.normalize(found)
    return None if found is None or found.startswith("/") else found


@F.pandas_udf(T.StringType())
def _archive_locator(virtual: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([archive_locator(v, n) for v, n in zip(virtual, name)], dtype=object)


def wanted_paths(outer: str | None, root: str | None, locator: str | None) -> list[dict] | None:
    """Where a locator may lie, by distance from the source's directory; None if it can't be
    followed at all."""
    if outer is None or root is None or not paths.contains(outer, root):
        return None
    inner = paths.normalize(locator)
    if inner is None or inner.startswith("/") or inner[1:2] == ":":
        return None
    out = []
    for depth, directory in enumerate(paths.ancestors(paths.parent(outer), root)):
        wanted = paths.join(directory, locator)
        if wanted is None:
            # The walk ends here; nearer directories were tried before.
            out.append({"depth": depth, "wanted": None})
            break
        if paths.contains(wanted, root):
            out.append({"depth": depth, "wanted": wanted})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("wanted", T.StringType())])))
def _wanted(outer: pd.Series, root: pd.Series, locator: pd.Series) -> pd.Series:
    return pd.Series([wanted_paths(o, r, x) or [] for o, r, x in zip(outer, root, locator)], dtype=object)


def _located(nodes: DataFrame) -> DataFrame:
    """Nodes with normalised paths; one outside its scope can't be found."""
    n = nodes.withColumns({"outer_n": paths.normalized("outer_path"), "root_n": paths.normalized("scope_root"), "member_n": paths.normalized("member_name")})
    inside = (
        (F.col("outer_n").startswith("/") == F.col("root_n").startswith("/"))
        & F.when(F.col("outer_n") == F.col("root_n"), True)
        .when(F.col("root_n") == ".", (F.col("outer_n") != "..") & ~F.col("outer_n").startswith("../"))
        .when(F.col("root_n").endswith("/"), F.col("outer_n").startswith(F.col("root_n")))
        .otherwise(F.col("outer_n").startswith(F.concat("root_n", F.lit("/")))))
    return n.withColumn("in_scope", F.coalesce(inside, F.lit(False)))


def _guid_fits(builtin: Column | None = None) -> Column:
    zero = F.col("x_guid") == F.lit(ZERO_GUID)
    fits = zero | (F.coalesce(F.col("c_has_guid"), F.lit(False)) & (F.col("c_guid") == F.col("x_guid")))
    return fits if builtin is None else builtin | fits


def resolve(nodes: DataFrame, objects: DataFrame, externals: DataFrame, pointers: DataFrame) -> DataFrame:
    """``pointer, status, target, external_ordinal`` for every pointer.

    nodes: ``node, outer_path, member_name, is_member, scope_root, has_guid, guid``;
    objects: ``node, ordinal, path_id, class_id``;
    externals: ``node, ordinal, virtual_path, path_name, guid, type``;
    pointers: ``pointer, node, file_id, path_id, expected_class`` (null for any).  One of a node
    that ``nodes`` doesn't hold is ``source-missing`` unless its own ids decide.
    """
    located = _located(nodes)
    x = externals.select(
        F.col("node").alias("x_node"), F.col("ordinal").alias("external_ordinal"), "virtual_path", "path_name", F.col("guid").alias("x_guid"), F.col("type").alias("x_type"))
    p = pointers.join(x, (F.col("node") == F.col("x_node")) & (F.col("file_id") - 1 == F.col("external_ordinal")) & (F.col("path_id") != 0), "left").drop("x_node")
    no_name = F.col("path_name").isNull() | F.col("virtual_path").isNull() | (F.col("path_name") == "")
    is_archive = F.col("virtual_path").startswith(ARCHIVE) | F.col("path_name").startswith(ARCHIVE)
    built, broken, library = F.lit(False), F.lit(False), F.lit(None).cast("string")
    for name, (guid, place) in BUILTIN.items():
        here = F.col("path_name") == name
        right = (F.col("x_type") == 0) & (F.col("x_guid") == F.lit(guid))
        built, broken = built | (here & right), broken | (here & ~right)
        library = F.when(here, place).otherwise(library)
    route = (
        F.when(F.col("path_id") == 0, "null").when(F.col("file_id") < 0, "invalid-file-id").when(F.col("file_id") == 0, "local")
        .when(F.col("external_ordinal").isNull(), "invalid-file-id").when(no_name, "out-of-scope").when(is_archive, "archive")
        .when(F.col("virtual_path") != "", "out-of-scope").when(broken, "out-of-scope").otherwise("loose"))
    p = p.withColumns({"route": route, "builtin": F.coalesce(built, F.lit(False)), "locator": F.coalesce(library, F.col("path_name"))})
    source = located.select(
        "node", F.col("outer_n").alias("s_outer"), F.col("root_n").alias("s_root"), F.col("in_scope").alias("s_in_scope"), F.col("is_member").alias("s_member"))
    p = p.join(source, "node", "left")
    candidate = located.where("in_scope").select(
        F.col("node").alias("target"), F.col("outer_n").alias("c_outer"), F.col("root_n").alias("c_root"), F.col("member_n").alias("c_member_name"),
        F.col("is_member").alias("c_member"), F.col("has_guid").alias("c_has_guid"), F.col("guid").alias("c_guid"))

    loose = p.where("route = 'loose' AND s_in_scope").withColumn("step", F.explode(_wanted("s_outer", "s_root", "locator")))
    loose = loose.select("pointer", "builtin", "x_guid", "s_root", "step.depth", "step.wanted")
    hits = loose.join(candidate.where("NOT c_member"), (F.col("wanted") == F.col("c_outer")) & (F.col("s_root") == F.col("c_root"))).where(_guid_fits(F.col("builtin")))
    per_depth = hits.groupBy("pointer", "depth").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    loose_found = per_depth.groupBy("pointer").agg(F.min_by(F.struct("n", "target"), "depth").alias("hit"))

    inner = p.where("route = 'archive' AND s_in_scope AND s_member").withColumn("wanted", _archive_locator("virtual_path", "path_name"))
    inner = inner.where("wanted IS NOT NULL").select("pointer", "x_guid", "s_root", "s_outer", "wanted")
    in_archive = inner.join(
        candidate.where("c_member"), (F.col("wanted") == F.col("c_member_name")) & (F.col("s_outer") == F.col("c_outer")) & (F.col("s_root") == F.col("c_root"))).where(_guid_fits())
    archive_found = in_archive.groupBy("pointer").agg(F.count("*").alias("n"), F.min("target").alias("target")).select("pointer", F.struct("n", "target").alias("hit"))

    p = p.join(loose_found.unionByName(archive_found), "pointer", "left")
    outside = F.col("route").isin("loose", "archive")
    target = F.when(F.col("route") == "local", F.col("node")).when(outside & (F.col("hit.n") == 1), F.col("hit.target"))
    early = (
        F.when(~outside & (F.col("route") != "local"), F.col("route"))
        .when(F.col("s_member").isNull(), "source-missing").when(outside & F.col("hit").isNull(), "out-of-scope").when(outside & (F.col("hit.n") > 1), "ambiguous"))
    p = p.withColumns({"target": target, "early": early})
    firsts = first_match(objects, ["node", "path_id"], "ordinal").select(F.col("node").alias("o_node"), F.col("path_id").alias("o_path_id"), "class_id")
    p = p.join(firsts, (F.col("target") == F.col("o_node")) & (F.col("path_id") == F.col("o_path_id")), "left")
    success = F.when(F.col("route") == "local", "local").when((F.col("route") == "loose") & F.col("builtin"), "external-builtin-contract").otherwise("external-exact")
    status = (
        F.coalesce(
            F.col("early"),
            F.when(F.col("o_node").isNull(), "target-missing")
            .when(F.col("expected_class").isNotNull() & (F.col("class_id") != F.col("expected_class")), "target-wrong-class")
            .otherwise(success)))
    seen = F.when((F.col("path_id") != 0) & (F.col("file_id") > 0), F.col("external_ordinal"))
    return p.select("pointer", status.alias("status"), "target", seen.alias("external_ordinal"))
