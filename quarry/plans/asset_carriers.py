"""More decoders and resolvers over packed files, each with several outcomes, and their SQL.

As in ``packed_carriers``, rows of a table are packed into the format; here what is packed
differs from row to row, so that accepting and refusing branches are both compared.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.decode import build_settings as settings
from quarry.decode import encode, objects
from quarry.functions import binary, paths
from quarry.operators import constraints, lookups, references, trees
from quarry.sources import files, tables

from .carriers import _table, query
from .packed_carriers import HASH, _packed


def _text(order: str, value: bytes) -> bytes:
    return struct.pack(order + "I", len(value)) + value + bytes(-len(value) % 4)


# References to other files

@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 25 AS n, o_orderkey % 11 AS f, o_orderkey % 5 AS p, o_orderkey % 7 = 0 AS strict FROM orders),
x AS (SELECT o.*, n_regionkey AS r FROM o JOIN nation ON n_nationkey = n),
found AS (SELECT *, CASE
    WHEN p = 0 THEN 'null' WHEN f = 10 THEN 'invalid-file-id'
    WHEN f IN (2, 4, 6, 7, 9) THEN 'out-of-scope' WHEN f = 1 THEN 'ambiguous' ELSE NULL END AS early,
  CASE WHEN f = 0 THEN CASE WHEN n % 5 = 0 THEN 2000 + n ELSE 1000 + r END WHEN f = 3 THEN 4000 WHEN f = 5 THEN 6000 WHEN f = 8 THEN n END AS place FROM x)
SELECT o_orderkey, coalesce(early, CASE WHEN p = 4 THEN 'target-missing' WHEN strict THEN 'target-wrong-class' WHEN f = 3 THEN 'external-builtin-contract' WHEN f = 8 THEN 'local' ELSE 'external-exact' END) AS status,
  CASE WHEN early IS NULL THEN CAST(place AS BIGINT) END AS target FROM found""")
def external_references(spark, sf_dir):
    """Orders as pointers of 25 loose files, each with ten externals: by nearest directory, of
    two files of one name, of none, built-in with the right and the wrong guid, by a right and
    a wrong guid, of another protocol, local, without a name, and beyond the list."""
    guid, other = bytes(range(16)), bytes(range(1, 17))
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    region = nation.select("r").distinct()

    def node(rows, key, path, has=False, value=bytes(16)):
        return rows.select(
            key.cast("long").alias("node"), path.alias("outer_path"), F.lit(None).cast("string").alias("member_name"), F.lit(False).alias("is_member"),
            F.lit("/p").alias("scope_root"), F.lit(has).alias("has_guid"), F.lit(value).alias("guid"))

    one = spark.range(1)
    own = F.format_string("/p/r%d/n%d", "r", "n")
    nodes = node(nation, F.col("n"), F.concat(own, F.lit("/main.assets")))
    for more in (
        node(region, F.col("r") + 1000, F.format_string("/p/r%d/shared.assets", "r")),
        node(nation.where("n % 5 = 0"), F.col("n") + 2000, F.concat(own, F.lit("/./shared.assets"))),
        node(one, F.lit(3000), F.lit("/p/twice.assets")), node(one, F.lit(3001), F.lit("/p/x/../twice.assets")),
        node(one, F.lit(4000), F.lit("/p/Resources/unity default resources")),
        node(one, F.lit(6000), F.lit("/p/guided.assets"), True, guid), node(one, F.lit(6001), F.lit("/p/other.assets"), True, guid),
    ):
        nodes = nodes.unionByName(more)
    library = "Library/unity default resources"
    right = references.BUILTIN[library][0]
    listed = [
        ("", "shared.assets", bytes(16), 0), ("", "twice.assets", bytes(16), 0), ("", "nowhere.assets", bytes(16), 0), ("", library, right, 0), ("", library, right, 1),
        ("", "guided.assets", guid, 0), ("", "other.assets", other, 0), ("library:/x", "shared.assets", bytes(16), 0), ("", "shared.assets", bytes(16), 0), ("", "", bytes(16), 0)]
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(listed)], "ordinal int, virtual_path string, path_name string, guid binary, type int")
    externals = nation.select(F.col("n").alias("node")).crossJoin(F.broadcast(rows))  # ten rows a file
    held = nodes.select("node", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    held = held.select("node", F.col("k").alias("ordinal"), F.col("k").cast("long").alias("path_id"), F.lit(5).alias("class_id"))
    key = F.col("o_orderkey")
    file_id = F.when(key % 11 == 8, 0).otherwise(key % 11 + 1)
    pointers = _table(spark, sf_dir, "orders").select(
        key.alias("pointer"), (key % 25).cast("long").alias("node"), file_id.cast("int").alias("file_id"), (key % 5).cast("long").alias("path_id"), F.when(key % 7 == 0, 6).otherwise(5).alias("expected_class"))
    return references.resolve(nodes, held, externals, pointers).select(F.col("pointer").alias("o_orderkey"), "status", "target")


@query("""
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'external-exact' WHEN 1 THEN 'out-of-scope' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'external-exact' WHEN 4 THEN 'out-of-scope' ELSE 'out-of-scope' END AS status,
  CASE WHEN s_suppkey % 6 IN (0, 3) THEN CAST(s_nationkey AS BIGINT) + 100 END AS target FROM supplier""")
def archive_references(spark, sf_dir):
    """Suppliers as pointers from a member of their nation's archive to other members: by name,
    of none, of two, by both names, by two that differ, and from a loose file."""
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("n"))
    n = supplier.select("n").distinct()
    file = F.format_string("/a/n%d.bundle", "n")

    def node(key, path, member):
        return n.select(key.cast("long").alias("node"), path.alias("outer_path"), member.alias("member_name"), member.isNotNull().alias("is_member"), F.lit("/a").alias("scope_root"), F.lit(False).alias("has_guid"), F.lit(bytes(16)).alias("guid"))

    nodes = node(F.col("n"), file, F.lit("CAB-own"))
    for more in (
        node(F.col("n") + 100, file, F.lit("CAB-one")), node(F.col("n") + 200, file, F.lit("CAB-two")), node(F.col("n") + 300, file, F.lit("CAB-x/../CAB-two")),
        node(F.col("n") + 400, F.format_string("/a/n%d.assets", "n"), F.lit(None).cast("string"))):
        nodes = nodes.unionByName(more)
    names = ["archive:/CAB-one", "archive:/CAB-none", "archive:/CAB-two", "archive:/./CAB-one", "archive:/CAB-one", "archive:/CAB-one"]
    virtual = ["", "", "", "archive:/CAB-one", "archive:/CAB-two", ""]
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    source = F.col("n") + F.when(F.col("s_suppkey") % 6 == 5, 400).otherwise(0)
    rows = [(k, virtual[k], names[k], bytes(16), 0) for k in range(6)]
    listed = spark.createDataFrame(rows, "ordinal int, virtual_path string, path_name string, guid binary, type int")
    externals = n.select(F.explode(F.array(F.col("n"), F.col("n") + 400)).alias("node")).crossJoin(F.broadcast(listed))  # six rows a file
    held = nodes.select("node", F.lit(0).alias("ordinal"), F.lit(1).cast("long").alias("path_id"), F.lit(5).alias("class_id"))
    pointers = supplier.select(F.col("s_suppkey").alias("pointer"), source.alias("node"), pick(range(1, 7)).alias("file_id"), F.lit(1).cast("long").alias("path_id"), F.lit(None).cast("int").alias("expected_class"))
    return references.resolve(nodes, held, externals, pointers).select(F.col("pointer").alias("s_suppkey"), "status", "target")


# Schemas

_GOOD = [("Part", "Base", 0, -1, 0), ("int", "size", 1, 4, 0), ("string", "name", 1, -1, 0), ("Array", "Array", 2, -1, 0x4000), ("int", "size", 3, 4, 0), ("char", "data", 3, 1, 0), ("vector", "list", 1, -1, 0), ("Array", "Array", 2, -1, 0), ("int", "size", 3, 4, 0), ("UInt8", "data", 3, 1, 0)]


def _with(at: int, field: tuple) -> list[tuple]:
    return [*_GOOD[:at], field, *_GOOD[at + 1:]]


_SHAPES = [
    _GOOD,                                                  # sound
    _with(1, ("int", "size", 1, 8, 0)),                     # 1: a scalar of another width
    _with(4, ("int", "length", 3, 4, 0)),                   # 2: an array without size, as its owner is first
    _with(5, ("UInt8", "data", 3, 1, 0)),                   # 2: a string of other things than char
    _GOOD[:3] + _GOOD[6:],                                  # 2: a string with nothing below
    [*_GOOD, ("Thing", "what", 1, -1, 0)],                  # 10: a leaf of no known width
    _with(0, ("Part", "Base", 0, -2, 0)),                   # 0: a size below -1
]


def _shape_files(spark, sf_dir) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"))
    blocks = {(k, big): encode.schema_block(f, big) for k, f in enumerate(_SHAPES) for big in (False, True)}
    return _packed(parts, lambda row: encode.serialized_file([(1, HASH, blocks[int(row["path"]) % 7, int(row["path"]) % 2 == 1])], [], b"", big=int(row["path"]) % 2 == 1))


@query("""
SELECT p_partkey, CAST(CASE p_partkey % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 10 WHEN 6 THEN 0 END AS INTEGER) AS grammar_error,
  CAST(min(p_partkey) OVER (PARTITION BY p_partkey % 7) AS BIGINT) AS first_same, 'unknown' AS profile FROM part""")
def schema_shapes(spark, sf_dir):
    """The first node that breaks the grammar, and the first part whose schema has the same
    shape digest, whatever the byte order."""
    found = tables.shapes(_shape_files(spark, sf_dir)).withColumn("p_partkey", F.col("path").cast("long"))
    first = found.groupBy("shape_digest").agg(F.min("p_partkey").alias("first_same"))
    return found.join(first, "shape_digest").select("p_partkey", "grammar_error", "first_same", "profile")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'ok' ELSE 'invalid-schema' END AS status,
  CAST(CASE p_partkey % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 10 WHEN 6 THEN 0 END AS BIGINT) AS row_ordinal FROM part""")
def refused_sources(spark, sf_dir):
    """One diagnostic for each source that is refused."""
    source = _shape_files(spark, sf_dir)
    found = source.select("path").join(tables.diagnostics(source).select("path", "status", "row_ordinal"), "path", "left")
    return found.select(F.col("path").cast("long").alias("p_partkey"), F.coalesce("status", F.lit("ok")).alias("status"), "row_ordinal")


_REGISTRY = [("ManagedReferencesRegistry", "references", 1, -1, 0, 4), ("int", "version", 2, 4, 0)]
_CONTEXTS = [
    _GOOD,
    [*_GOOD, *_REGISTRY],
    [_GOOD[0], *_REGISTRY, *_GOOD[1:]],
    [*_GOOD, ("ManagedReferencesRegistry", "references", 1, -1, 0, 5), ("int", "version", 2, 4, 0)],
    [*_GOOD, *_REGISTRY, *_REGISTRY],
]


@query("""
SELECT p_partkey, CASE WHEN k < 2 THEN 'ok' WHEN k = 3 THEN 'unsupported-registry-flags' ELSE 'unsupported-registry-position' END AS status,
  CAST(CASE WHEN k = 1 THEN 10 END AS INTEGER) AS registry, CAST(CASE k WHEN 0 THEN 10 WHEN 1 THEN 12 END AS INTEGER) AS ordinary_end, CAST(CASE WHEN k < 2 THEN 10 END AS INTEGER) AS selected_end
FROM (SELECT p_partkey, p_partkey % 5 AS k FROM part)""")
def schema_context(spark, sf_dir):
    """How far traversals go: without a registry, with one, with one in the wrong place, with
    wrong flags, and with two."""
    blocks = [encode.schema_block(f) for f in _CONTEXTS]
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"))
    source = _packed(parts, lambda row: encode.serialized_file([(1, HASH, blocks[int(row["path"]) % 5])], [], b""))
    keys = ["path", "row_kind", "type_ordinal"]
    found = trees.contexts(trees.links(tables.type_nodes(source), keys), keys)
    whole = [F.col(c).cast("int").alias(c) for c in ("registry", "ordinary_end", "selected_end")]
    return found.select(F.col("path").cast("long").alias("p_partkey"), "status", *whole)


# Values

_VALUE = [
    ("Part", "Base", 0, -1, 0), ("Dims", "dims", 1, -1, 0), ("int", "size", 2, 4, 0), ("UInt64", "big", 2, 8, 0), ("string", "name", 1, -1, 0), ("Array", "Array", 2, -1, 0x4000),
    ("int", "size", 3, 4, 0), ("char", "data", 3, 1, 0), ("vector", "list", 1, -1, 0), ("Array", "Array", 2, -1, 0), ("int", "size", 3, 4, 0), ("SInt16", "data", 3, 2, 0)]


def _value_files(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_size", "p_brand")
    blocks = {big: encode.schema_block(_VALUE, big) for big in (False, True)}

    def pack(row: dict) -> bytes:
        k = int(row["path"])
        order = ">" if k % 2 else "<"
        n = k % 4
        body = struct.pack(order + "iQ", -row["p_size"], (1 << 63) * (k % 3 == 0) + k) + _text(order, row["p_brand"].encode()) + struct.pack(f"{order}I{n}h", n, *range(n))
        return encode.serialized_file([(1, HASH, blocks[k % 2 == 1])], [(7, 0, len(body), 0)], body, big=k % 2 == 1)

    return _packed(rows, pack)


@query("""
WITH x AS (SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS size, p_partkey % 3 = 0 AS wide, p_partkey % 4 AS n FROM part),
paths(path) AS (VALUES (''), ('dims/size'), ('dims.big'), ('name'), ('list'), ('list/Array'), ('dims/none'), ('name/size'))
SELECT p_partkey, path AS value_path,
  CASE path WHEN '' THEN 'struct' WHEN 'dims/size' THEN 'int' WHEN 'dims.big' THEN 'int' WHEN 'name' THEN 'string' WHEN 'list' THEN 'array' END AS kind,
  CASE path WHEN 'dims/size' THEN -size WHEN 'dims.big' THEN CASE WHEN NOT wide THEN CAST(p_partkey AS BIGINT) END END AS as_int,
  CASE WHEN path = 'dims.big' THEN CAST(p_partkey AS VARCHAR) END AS low_uint, CASE WHEN path = 'name' THEN p_brand END AS text, CASE WHEN path = 'list' THEN CAST(n AS BIGINT) END AS count
FROM x, paths""")
def path_extract(spark, sf_dir):
    """What paths into a value lead to, and what each accessor makes of it."""
    found = tables.value_paths(_value_files(spark, sf_dir), ["", "dims/size", "dims.big", "name", "list", "list/Array", "dims/none", "name/size"])
    top = F.lit(str(1 << 63)).cast("decimal(20,0)")
    low = F.when(F.col("as_uint") >= top, F.col("as_uint") - top).otherwise(F.col("as_uint")).cast("long").cast("string")
    return found.select(F.col("path").cast("long").alias("p_partkey"), "value_path", "kind", "as_int", low.alias("low_uint"), F.decode("text", "UTF-8").alias("text"), "count")


@query("""
WITH x AS (SELECT p_partkey, p_size, p_brand, p_partkey % 4 AS n, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS wide FROM part)
SELECT p_partkey, CAST(min(p_partkey) OVER (PARTITION BY p_size % 5, p_brand, p_partkey % 2) AS BIGINT) AS first_same FROM x""")
def value_digests(spark, sf_dir):
    """The first part with an equal value digest: byte order doesn't count, nor whether an array
    of bytes was packed."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_size", "p_brand")
    fields = [*_VALUE[:1], *(("int", "size", 1, 4, 0),), *_GOOD[2:]]
    blocks = {big: encode.schema_block(fields, big) for big in (False, True)}

    def pack(row: dict) -> bytes:
        k = int(row["path"])
        big = k % 3 == 0
        order = ">" if big else "<"
        body = struct.pack(order + "i", row["p_size"] % 5) + _text(order, row["p_brand"].encode()) + struct.pack(order + "I", 2) + bytes([k % 2, 7])
        return encode.serialized_file([(1, HASH, blocks[big])], [(7, 0, len(body), 0)], body, big=big)

    found = tables.tree_values(_packed(rows, pack)).where("value_digest IS NOT NULL").select(F.col("path").cast("long").alias("p_partkey"), "value_digest")
    first = found.groupBy("value_digest").agg(F.min("p_partkey").alias("first_same"))
    return found.join(first, "value_digest").select("p_partkey", "first_same")


@query("""
SELECT p_partkey, x.ordinal, parent, first_child, CASE WHEN p_partkey % 2 = 1 AND x.ordinal = 4 THEN NULL ELSE next_sibling END AS next_sibling,
  CASE WHEN p_partkey % 2 = 1 AND x.ordinal = 0 THEN 2 ELSE child_count END AS child_count, CASE WHEN p_partkey % 2 = 1 AND x.ordinal = 0 THEN 8 ELSE subtree_end END AS subtree_end
FROM part, (VALUES (0, NULL, 1, NULL, 3, 12), (1, 0, 2, 4, 2, 4), (2, 1, NULL, 3, 0, 3), (3, 1, NULL, NULL, 0, 4), (4, 0, 5, 8, 1, 8), (5, 4, 6, NULL, 2, 8),
  (6, 5, NULL, 7, 0, 7), (7, 5, NULL, NULL, 0, 8), (8, 0, 9, NULL, 1, 12), (9, 8, 10, NULL, 2, 12), (10, 9, NULL, 11, 0, 11), (11, 9, NULL, NULL, 0, 12)) x(ordinal, parent, first_child, next_sibling, child_count, subtree_end)
WHERE p_partkey % 2 = 0 OR x.ordinal < 8""")
def schema_links(spark, sf_dir):
    """The links of a schema's nodes, one tree a part and two kinds of them."""
    blocks = [encode.schema_block(_VALUE), encode.schema_block(_VALUE[:8])]
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"))
    source = _packed(rows, lambda row: encode.serialized_file([(1, HASH, blocks[int(row["path"]) % 2])], [], b""))
    found = trees.links(tables.type_nodes(source), ["path", "row_kind", "type_ordinal"])
    return found.select(F.col("path").cast("long").alias("p_partkey"), "ordinal", "parent", "first_child", "next_sibling", "child_count", "subtree_end")


def _shape(rows: list[tuple]) -> list[tuple]:
    """A known shape as fields to pack, an authored name where it has none."""
    return [(kind or "Authored", name or "authored", level, size, meta, flags) for kind, name, level, flags, size, meta in rows]


@query("""
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, x.ordinal, x.kind, x.field_name,
  CASE x.ordinal WHEN 1 THEN sha256(coalesce(source, '')) WHEN 2 THEN sha256(coalesce(text, '')) END AS sha256
FROM documents d, (VALUES (0, 'container', 'Base'), (1, 'byte-string', 'm_Name'), (2, 'byte-string', 'm_Script')) x(ordinal, kind, field_name) WHERE d.doc_id % 4 <> 3
UNION ALL SELECT CAST(doc_id AS BIGINT), NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 4 = 3""")
def text_assets(spark, sf_dir):
    """Documents as text assets: two strings each; a fourth of them end too late and have no values."""
    block = encode.schema_block(_shape(objects.TEXT_ASSET))
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("source", F.lit("")).cast("binary").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def pack(row: dict) -> bytes:
        body = _text("<", bytes(row["name"])) + _text("<", bytes(row["text"])) + bytes(4 * (int(row["path"]) % 4 == 3))
        return encode.serialized_file([(49, HASH, block)], [(7, 0, len(body), 0)], body)

    source = _packed(rows, pack)
    found = source.select("path").join(tables.values(source).select("path", "ordinal", "kind", F.decode("field_name", "UTF-8").alias("field_name"), F.sha2("bytes", 256).alias("sha256")), "path", "left")
    return found.select(F.col("path").cast("long").alias("doc_id"), "ordinal", "kind", "field_name", "sha256")


@query("""
SELECT c_custkey, x.ordinal, x.kind, x.field_name, CAST(CASE x.ordinal WHEN 2 THEN c_custkey % 3 WHEN 3 THEN c_custkey WHEN 4 THEN 1 WHEN 6 THEN 0 WHEN 7 THEN -c_custkey
  WHEN 9 THEN CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END WHEN 10 THEN 2 WHEN 11 THEN c_custkey + 5 END AS BIGINT) AS bits
FROM customer, (VALUES (0, 2, 'container', 'Base'), (1, 2, 'container', 'm_GameObject'), (2, 2, 'signed-integer', 'm_FileID'), (3, 2, 'signed-integer', 'm_PathID'), (4, 2, 'unsigned-integer', 'm_Enabled'),
  (5, 2, 'container', 'm_Script'), (6, 2, 'signed-integer', 'm_FileID'), (7, 2, 'signed-integer', 'm_PathID'), (8, 2, 'byte-string', 'm_Name'), (9, 0, 'signed-integer', 'authored'),
  (9, 1, 'container', 'authored'), (10, 1, 'signed-integer', 'm_FileID'), (11, 1, 'signed-integer', 'm_PathID')) x(ordinal, of, kind, field_name)
WHERE x.of = 2 OR x.of = c_custkey % 2""")
def scripted_objects(spark, sf_dir):
    """Customers as scripted objects of two shapes: 10 or 12 values with their integers."""
    blocks = [encode.schema_block(_shape(x)) for x in (objects.SCRIPTED_INT, objects.SCRIPTED_TEXT)]
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_nationkey")

    def pack(row: dict) -> bytes:
        k = int(row["path"])
        body = struct.pack("<iq", k % 3, k) + struct.pack("<B3x", 1) + struct.pack("<iq", 0, -k) + _text("<", b"name")
        body += struct.pack("<iq", 2, k + 5) if k % 2 else struct.pack("<i", row["c_nationkey"])
        return encode.serialized_file([(114, HASH, blocks[k % 2], 0)], [(7, 0, len(body), 0)], body)

    found = tables.values(_packed(rows, pack))
    return found.select(F.col("path").cast("long").alias("c_custkey"), "ordinal", "kind", F.decode("field_name", "UTF-8").alias("field_name"), "bits")


_HOST_BLOCK = encode.schema_block(_shape([*objects.HOST, *objects.REGISTRY]))
_ALPHA = encode.schema_block(_shape([*objects.PAYLOAD_TEXT, *objects.REGISTRY]))
_BETA = encode.schema_block(_shape([*objects.PAYLOAD_FLOAT, *objects.REGISTRY]))


def _host(order: int, total: float) -> bytes:
    """A host whose first slot points to row 1, its second by the order to row 2, none or null."""
    second = (2, 99, -2)[order % 3]
    body = struct.pack("<iq", 0, 0) + struct.pack("<B3x", 1) + struct.pack("<iq", 0, 0) + _text("<", b"host") + _text("<", b"label")
    body += struct.pack("<qqI", 1, second, 1) + struct.pack("<q", 1) + struct.pack("<i", 2)
    rows = [(-2, b"", b"", b"", b""), (1, b"Alpha", b"N", b"A", struct.pack("<i", order % 100) + _text("<", b"x") + struct.pack("<q", -2)), (2, b"Beta", b"N", b"A", struct.pack("<ifq", 8, total, 1))]
    if order % 5 == 4:  # a class that no reference type has
        rows[2] = (2, b"Gamma", b"N", b"A", b"")
    body += struct.pack("<i", len(rows))
    for rid, name, space, assembly, payload in rows:
        body += struct.pack("<q", rid) + _text("<", name) + _text("<", space) + _text("<", assembly) + payload
    return encode.serialized_file([(114, HASH, _HOST_BLOCK, 0)], [(7, 0, len(body), 0)], body, references=[(HASH, _ALPHA, b"Alpha", b"N", b"A"), (HASH, _BETA, b"Beta", b"N", b"A")])


def _hosts(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"))
    return _packed(rows, lambda row: _host(int(row["path"]), 1.5))


@query("""
SELECT c_custkey, x.ordinal, CASE x.ordinal WHEN 1 THEN CASE c_custkey % 3 WHEN 0 THEN 'unique' WHEN 1 THEN 'missing' ELSE 'null' END WHEN 3 THEN 'null' ELSE 'unique' END AS resolution,
  CAST(CASE WHEN x.ordinal = 1 AND c_custkey % 3 = 1 THEN 0 ELSE 1 END AS BIGINT) AS match_count
FROM customer, (VALUES (0), (1), (2), (3), (4)) x(ordinal) WHERE c_custkey % 5 <> 4""")
def managed_references(spark, sf_dir):
    """The slots of managed hosts against their registries' rows; a host with a row of unknown
    class is refused whole."""
    source = _hosts(spark, sf_dir)
    found = lookups.resolve_rids(tables.rid_slots(source), tables.registry_rows(source))
    return found.select(F.col("path").cast("long").alias("c_custkey"), "ordinal", "resolution", "match_count")


@query("""
SELECT c_custkey, CAST(5 AS BIGINT) AS slots, CAST(CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS missing, CAST(0 AS BIGINT) AS ambiguous FROM customer WHERE c_custkey % 5 <> 4""")
def managed_totals(spark, sf_dir):
    source = _hosts(spark, sf_dir)
    found = lookups.rid_totals(lookups.resolve_rids(tables.rid_slots(source), tables.registry_rows(source)))
    return found.select(F.col("path").cast("long").alias("c_custkey"), "slots", "missing", "ambiguous")


@query("""
SELECT c_custkey, x.* FROM customer, (VALUES (0, -2, 'null', '', 0, 0), (1, 1, 'selected-payload', 'Alpha', 1, 20), (2, 2, 'selected-payload', 'Beta', 1, 16)) x(ordinal, rid, kind, class_name, match_count, payload_size)
WHERE c_custkey % 5 <> 4""")
def managed_registry(spark, sf_dir):
    found = tables.registry_rows(_hosts(spark, sf_dir))
    return found.select(
        F.col("path").cast("long").alias("c_custkey"), "ordinal", F.col("rid").cast("int").alias("rid"), "kind", F.decode("class_name", "UTF-8").alias("class_name"), F.col("match_count").cast("int").alias("match_count"),
        F.col("payload_size").cast("int").alias("payload_size"))


# Build settings

@query("""
SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'build-settings-missing' WHEN 2 THEN 'build-settings-duplicate' WHEN 3 THEN 'type-identity-unsupported'
  WHEN 4 THEN 'boolean-invalid' WHEN 5 THEN 'version-mismatch' WHEN 6 THEN 'object-bytes-not-exhausted' WHEN 7 THEN 'string-length-invalid' ELSE 'payload-truncated' END AS status,
  CAST(CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey % 4 END AS INTEGER) AS scene_count, CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey % 2 = 1 END AS is_trial,
  CAST(CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey % 100 END AS INTEGER) AS graphics FROM supplier""")
def build_settings(spark, sf_dir):
    """Settings of suppliers' players, one sound and eight unsound kinds."""
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"))

    def pack(row: dict) -> bytes:
        k = int(row["path"])
        kind = k % 9
        flags = bytearray(15)
        flags[settings.FLAGS.index("is_trial")] = 2 if kind == 4 else k % 2
        scenes = struct.pack("<i", k % 4) + _text("<", b"scene") * (k % 4) + struct.pack("<iii", 0, 0, 0)
        if kind == 7:
            scenes = struct.pack("<ii", 1, -1) + struct.pack("<iii", 0, 0, 0)
        body = scenes + bytes(range(16)) + bytes(flags) + b"\0"
        body += _text("<", b"2021.3.35f2" if kind == 5 else b"2021.3.35f1") + struct.pack("<ii", 1, k % 100) + bytes(4 * (kind == 6))
        body = scenes + bytes(10) if kind == 8 else body
        found = [] if kind == 1 else [(1, 0, len(body), 0), (2, 0, len(body), 0)] if kind == 2 else [(1, 0, len(body), 0)]
        return encode.serialized_file([(settings.CLASS, HASH if kind == 3 else settings.TYPE_HASH, None)], found, body)

    found = tables.build_settings_table(_packed(rows, pack))
    return found.select(F.col("path").cast("long").alias("s_suppkey"), "status", "scene_count", "is_trial", F.col("graphics_apis")[0].alias("graphics"))


# Archives

def _supply_archives(spark, sf_dir) -> DataFrame:
    """Archives, stored, by LZMA and by LZ4, with none, one or two members called ``level0``."""
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), "s_name")

    def pack(row: dict) -> bytes:
        k, name = int(row["path"]), row["s_name"].encode()
        members = [(b"body.resS", 0, name * 3)] + [(b"level0", 4, name)] * (k % 3)
        return encode.archive(members, compressed=k % 4 % 3)

    return _packed(rows, pack)


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'duplicate' END AS status, CAST(CASE WHEN s_suppkey % 3 = 1 THEN 1 END AS INTEGER) AS ordinal FROM supplier")
def member_by_name(spark, sf_dir):
    found = lookups.member_by_name(tables.members(_supply_archives(spark, sf_dir)), "level0")
    return found.select(F.col("path").cast("long").alias("s_suppkey"), "status", "ordinal")


@query("""
SELECT s_suppkey, CAST(length(s_name) * (3 + s_suppkey % 3) AS BIGINT) AS payload, true AS covered,
  sha256(s_name || s_name || s_name || CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE '' END || CASE WHEN s_suppkey % 3 = 2 THEN s_name ELSE '' END) AS sha256 FROM supplier""")
def archive_coverage(spark, sf_dir):
    """Whether the blocks of archives cover their data, and what they hold."""
    files = _supply_archives(spark, sf_dir)
    heads = tables.archives(files)
    lead = len(encode.SIGNATURE + encode.GENERATION + encode.ENGINE) + 3 + 4 + 20
    region = (F.col("total_size") - (lead + -lead % 16) - F.col("info_csize")).cast("long")
    covered = constraints.block_coverage(heads, tables.archive_blocks(files), region)
    whole = tables.members(files).groupBy("path").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.decode("data", "UTF-8").alias("text")))), lambda m: m["text"])).alias("text"))
    found = covered.join(whole, "path")
    return found.select(F.col("path").cast("long").alias("s_suppkey"), F.col("payload").cast("long").alias("payload"), "covered", F.sha2("text", 256).alias("sha256"))


@query("""
SELECT p_partkey, CASE k WHEN 0 THEN 'ok' WHEN 2 THEN 'unsupported' ELSE 'member-invalid' END AS status, CAST(CASE k WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS serialized_files,
  CAST(CASE WHEN k = 0 THEN 1 ELSE 0 END AS BIGINT) AS resource_members, CAST(CASE WHEN k = 3 THEN 2 ELSE 1 END AS BIGINT) AS directory_members, CAST(CASE WHEN k = 4 THEN 1 ELSE 0 END AS BIGINT) AS deleted_members
FROM (SELECT p_partkey, p_partkey % 6 AS k FROM part)""")
def archive_visit(spark, sf_dir):
    """Visits that end well, at a member that is no serialized file, at one of another version,
    at a directory or deleted member that isn't empty, and at one of no kind."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"))
    sound = encode.serialized_file([(1, HASH, None)], [], b"")
    other = sound[:8] + struct.pack(">I", 21) + sound[12:]
    third = [(b"level1", 4, sound), (b"level1", 4, b"nothing of the kind, but long"), (b"level1", 4, other), (b"sub", 1, b"x"), (b"gone", 2, b"x"), (b"what", 0, b"")]

    def pack(row: dict) -> bytes:
        return encode.archive([(b"folder", 1, b""), (b"level0", 4, sound), third[int(row["path"]) % 6], (b"data.resource", 0, b"r")])

    found = constraints.visit(tables.members(_packed(rows, pack)), files.probe(F.col("data"))["kind"])
    return found.select(F.col("path").cast("long").alias("p_partkey"), *found.columns[1:])


# Sources and their objects

@query("""
SELECT n_nationkey AS nation, CAST(4 AS BIGINT) AS n_objects, CAST(CASE WHEN n_nationkey % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS duplicate_ids,
  CAST(CASE WHEN n_nationkey % 4 = 2 THEN 1 ELSE 0 END AS BIGINT) AS overlapping, n_nationkey % 3 <> 1 AND n_nationkey % 4 <> 2 AS accepted FROM nation""")
def semantic_open(spark, sf_dir):
    """Which files the semantic view accepts: some repeat an id, some have payloads that overlap."""
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"))

    def pack(row: dict) -> bytes:
        k = int(row["path"])
        found = [(1, 0, 8, 0), (2, 8, 0, 0), (1 if k % 3 == 1 else 3, 8, 8, 0), (4, 12 if k % 4 == 2 else 16, 4, 0)]
        return encode.serialized_file([(1, HASH, None)], found, bytes(32), big=k % 2 == 1)

    report = constraints.object_table_report(tables.objects_table(_packed(rows, pack)))
    return report.select(F.col("path").cast("int").alias("nation"), "n_objects", "duplicate_ids", "overlapping", "accepted")


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS byte_size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def payload_slices(spark, sf_dir):
    """Documents as the second payload of a file each, cut out again."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    source = _packed(rows, lambda row: encode.serialized_file([(1, HASH, None)], [(1, 0, 5, 0), (2, 5, len(row["text"]), 0)], b"first" + bytes(row["text"])))
    found = tables.payloads(tables.objects_table(source).where("path_id = 2"), source)
    return found.select(F.col("path").cast("long").alias("doc_id"), "byte_size", F.sha2("payload", 256).alias("sha256"))


@query("""
SELECT p_partkey, p_partkey % 2 = 0 AS available FROM part""")
def identity_gate(spark, sf_dir):
    """Whether a source's reference types carry names, which they do only with schemas."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"))

    def pack(row: dict) -> bytes:
        named = int(row["path"]) % 2 == 0
        block = _ALPHA if named else None
        return encode.serialized_file([(1, HASH, block)], [], b"", references=[(HASH, block, b"Alpha", b"N", b"A")])

    found = lookups.identities_available(tables.ref_types(_packed(rows, pack)))
    return found.select(F.col("path").cast("long").alias("p_partkey"), "available")


# Schema registry

def _entries(spark, sf_dir) -> DataFrame:
    """Schema entries of parts' files: two types each, the second with a schema for every third."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_size")
    block = encode.schema_block(_GOOD)

    def pack(row: dict) -> bytes:
        k, hashes = int(row["path"]), [bytes([row["p_size"] % 10, kind]) + bytes(14) for kind in (0, 1)]
        tree = block if k % 3 == 0 else None
        return encode.serialized_file([(row["p_size"] % 10 + 1, hashes[0], tree), (row["p_size"] % 10 + 1, hashes[1], tree)], [], b"")

    return tables.schema_entries(_packed(rows, pack))


@query("""
WITH known AS (SELECT DISTINCT p_size % 10 AS c FROM part WHERE p_partkey % 3 = 0 AND p_size % 10 < 7)
SELECT p_partkey, x.ordinal AS type_ordinal, p_partkey % 3 = 0 OR (p_size % 10 = 4 AND k.c IS NOT NULL) AS has_schema
FROM part LEFT JOIN known k ON k.c = p_size % 10, (VALUES (0), (1)) x(ordinal)""")
def class_resolution(spark, sf_dir):
    """Schemas from the registry for the rows of one class; others and embedded ones stay."""
    entries = _entries(spark, sf_dir)
    registry = entries.where("schema IS NOT NULL AND class_id < 8").dropDuplicates(list(lookups.KEY))
    found = lookups.resolve_class(entries, registry, 5)
    return found.select(F.col("path").cast("long").alias("p_partkey"), "type_ordinal", F.col("schema").isNotNull().alias("has_schema"))


@query("""
WITH known AS (SELECT DISTINCT p_size % 10 AS c FROM part WHERE p_partkey % 3 = 0 AND p_size % 10 < 7)
SELECT p_partkey, k.c IS NOT NULL AS resolved, CAST(CASE WHEN k.c IS NULL THEN 2 ELSE 0 END AS BIGINT) AS missing FROM part LEFT JOIN known k ON k.c = p_size % 10 WHERE p_partkey % 3 <> 0""")
def source_resolution(spark, sf_dir):
    """Which sources without schemas find all of theirs in the registry."""
    entries = _entries(spark, sf_dir)
    registry = entries.where("schema IS NOT NULL AND class_id < 8").dropDuplicates(list(lookups.KEY))
    found = lookups.resolved_sources(entries, registry)
    return found.select(F.col("path").cast("long").alias("p_partkey"), "resolved", "missing")


@query("""
WITH classes AS (SELECT DISTINCT p_size % 10 AS c FROM part WHERE p_partkey % 3 = 0)
SELECT CAST(c + 1 AS INTEGER) AS class_id, x.kind, '2021.3.35f1' AS engine, lower(hex(chr(CAST(c AS INTEGER)))) || lpad(CAST(x.kind AS VARCHAR), 2, '0') || repeat('00', 14) AS type_hash
FROM classes, (VALUES (0), (1)) x(kind)""")
def registry_file(spark, sf_dir):
    """The registry of all embedded schemas, written as its canonical file and read back."""
    from quarry.decode import registry

    entries = _entries(spark, sf_dir).where("schema IS NOT NULL").dropDuplicates(list(lookups.KEY))
    columns = [c for c in entries.columns if c not in ("path", "member", "row_kind", "type_ordinal", "schema")]
    rows = [r.asDict(recursive=True) for r in entries.select(*columns).toLocalIterator()]  # at most MAX_ENTRIES
    rows = [r | {k: bytes(v) for k, v in r.items() if isinstance(v, (bytes, bytearray))} for r in rows]
    data = registry.serialize(rows)
    assert registry.serialize(rows[::-1]) == data
    back = registry.deserialize(data)
    table = spark.createDataFrame([(r["class_id"], r["type_hash"][1], r["engine"].decode(), r["type_hash"].hex()) for r in back], "class_id int, kind int, engine string, type_hash string")
    return table


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'not-found' WHEN 2 THEN 'key-conflict' ELSE 'invalid-schema' END AS status, p_partkey % 4 = 0 AS entered FROM part""")
def version_binding(spark, sf_dir):
    """Keys of another engine version: entered, without a like, with two, and of an unknown shape."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"))
    zero = F.lit(bytes(16))

    def key(engine: str, rows: DataFrame, *more) -> DataFrame:
        return rows.select(
            F.lit(22).alias("file_version"), F.lit(engine.encode()).alias("engine"), F.col("k").alias("class_id"), F.col("k").alias("type_id"), F.lit(65535).alias("script_index"),
            F.lit(False).alias("has_script_hash"), F.lit(False).alias("is_stripped"), F.lit(False).alias("is_ref"), zero.alias("script_hash"), F.lit(HASH).alias("type_hash"), *more)

    schema = lambda text: F.lit(text).alias("schema")
    shape = F.when(F.col("k") % 4 == 3, "odd").otherwise("even").alias("shape_digest")
    registry = key("a", part.where("k % 4 <> 1"), schema(b"one"), shape).unionByName(key("b", part.where("k % 4 = 2"), schema(b"two"), shape))
    profiles = part.select(F.lit(b"c").alias("engine"), F.col("k").alias("class_id"), F.lit(HASH).alias("type_hash"), F.lit("even").alias("shape_digest"))
    found = lookups.bind_version(registry, key("c", part), profiles)
    return found.select(F.col("class_id").cast("long").alias("p_partkey"), "status", F.col("schema").isNotNull().alias("entered"))


@query("""
WITH o AS (SELECT p_partkey % 20 AS c, p_partkey AS k, p_size % 2 AS s FROM part),
agreed AS (SELECT c, min(s) <> max(s) AS conflict FROM o GROUP BY c)
SELECT CAST(c AS INTEGER) AS class_id, CASE WHEN conflict THEN 'conflict' ELSE 'known' END AS status FROM agreed GROUP BY ALL
UNION ALL SELECT CAST(c AS INTEGER), 'known' FROM agreed WHERE conflict""")
def schema_conflict(spark, sf_dir):
    """Sources that offer schemas against a registry that holds the first of each pair."""
    part = _table(spark, sf_dir, "part")
    zero = F.lit(bytes(16))
    rows = part.select(
        F.lit(22).alias("file_version"), F.lit(b"e").alias("engine"), (F.col("p_partkey") % 20).cast("int").alias("class_id"), F.lit(1).alias("type_id"), F.lit(65535).alias("script_index"), F.lit(False).alias("has_script_hash"),
        F.lit(False).alias("is_stripped"), F.lit(False).alias("is_ref"), zero.alias("script_hash"), zero.alias("type_hash"), (F.col("p_size") % 2).cast("string").cast("binary").alias("schema"), F.col("p_partkey").cast("string").alias("path"), F.lit(0).alias("member"))
    registry = rows.groupBy(*lookups.KEY).agg(F.min("schema").alias("schema"))
    return lookups.learn(registry, rows).select("class_id", "status").distinct()


# Paths and text

@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) END AS error_at, doc_id % 3 <> 0 AS valid FROM documents""")
def utf8_measure(spark, sf_dir):
    """Texts, every third with a byte at its end that no character starts with."""
    data = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.when(F.col("doc_id") % 3 == 0, F.lit(b"\xff")).otherwise(F.lit(b"")))
    rows = _table(spark, sf_dir, "documents").select("doc_id", data.alias("data"))
    return rows.select("doc_id", binary.utf8_error(F.col("data")).alias("error_at"), binary.valid_utf8(F.col("data")).alias("valid"))


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'a/' || c_name WHEN 1 THEN c_name WHEN 2 THEN '../' || c_name WHEN 3 THEN '/' || c_name END AS path FROM customer""")
def path_normalise(spark, sf_dir):
    """Lexical normalisation; an absolute path that climbs above its root has none."""
    shapes = ["./a//%s/", "x/../%s", "../x/../%s", "/x/./../%s", "/../%s"]
    path = F.element_at(F.array(*(F.format_string(s, "c_name") for s in shapes)), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"))
    return rows.select("c_custkey", paths.normalized(F.col("path")).alias("path"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 OR o_custkey = 0 THEN 9223372036854775807 - o_custkey END AS total,
  CASE WHEN o_orderkey % 3 <> 0 OR o_custkey = 0 THEN CAST(o_custkey * 4 AS BIGINT) WHEN o_custkey = 1 THEN 4611686018427387904 END AS product FROM orders""")
def checked_arithmetic(spark, sf_dir):
    """Sums and products, null where they overflow."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("c"))
    top = F.lit((1 << 63) - 1)
    other = F.when(F.col("o_orderkey") % 2 == 0, F.col("c")).otherwise(-F.col("c"))
    factor = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1 << 62)).otherwise(F.lit(4).cast("long"))
    return o.select("o_orderkey", binary.checked_sum(top, other).alias("total"), binary.checked_product(F.col("c") * 1, factor).alias("product"))
