"""Decoders over files packed from the star-schema tables, with SQL for what must come out.

Each query packs rows of a table into the format, as an asset folder would hold them, and
decodes the bytes with the library's scans; the SQL states the rows that were packed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.decode import encode
from quarry.functions import binary
from quarry.operators import lookups, references
from quarry.sources import files, tables

from .carriers import _table, query

HASH = bytes(range(16))


def _packed(df: DataFrame, pack) -> DataFrame:
    """``path, member, data, content`` with one packed file per row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["path"], pack(r)) for r in batch.to_pylist()]
            data = pa.array([d for _, d in rows], pa.binary())
            yield pa.record_batch({"path": pa.array([p for p, _ in rows], pa.string()), "member": pa.array([0] * len(rows), pa.int32()), "data": data, "content": data})

    return df.mapInArrow(run, "path string, member int, data binary, content binary")


@query("""
SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS metadata_size, CAST(o_orderkey + 1000000 AS BIGINT) AS file_size,
  CAST(o_custkey + 48 AS BIGINT) AS data_offset, CAST(o_orderkey % 2 AS INTEGER) AS endian,
  CASE WHEN o_orderkey % 5 = 0 THEN 'unsupported-serialized-file' ELSE 'serialized-file' END AS kind FROM orders""")
def header_scan(spark, sf_dir):
    wide = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    o = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    head = F.concat(F.lit(struct.pack(">IIII", 0, 0, 22, 0)), wide(F.col("o_custkey")), wide(key + 1000000), wide(F.col("o_custkey") + 48), F.unhex(F.lpad(F.hex(key % 2), 2, "0")), F.lit(bytes(7)))
    rows = o.select("o_orderkey", head.alias("head"))
    logical = key + 1000000 + F.when(key % 5 == 0, 1).otherwise(0)
    found = rows.select("o_orderkey", files.header(F.col("head")).alias("h"), files.probe(F.col("head"), logical)["kind"].alias("kind"))
    return found.select("o_orderkey", *(F.col(f"h.{c}").cast("long").alias(c) for c in ("metadata_size", "file_size", "data_offset")), "h.endian", "kind")


_SUPPLY = "(SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k, CAST(s_suppkey % 97 AS BIGINT) AS size FROM supplier)"


def _supplier_files(spark, sf_dir) -> DataFrame:
    """A file per nation whose objects are its suppliers, one payload after the other."""
    s = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_suppkey")).alias("keys"))

    def pack(row: dict) -> bytes:
        sizes = [k % 97 for k in row["keys"]]
        objects = [(k, sum(sizes[:i]), n, i % 2) for i, (k, n) in enumerate(zip(row["keys"], sizes))]
        return encode.serialized_file([(1, HASH, None), (28, HASH, None)], objects, bytes(sum(sizes)), big=row["path"].endswith("1"))

    return _packed(s.select(F.col("s_nationkey").cast("string").alias("path"), "keys"), pack)


@query(f"""
SELECT CAST(s_nationkey AS VARCHAR) AS path, CAST(k AS INTEGER) AS ordinal, CAST(s_suppkey AS BIGINT) AS path_id,
  CAST(sum(size) OVER (PARTITION BY s_nationkey ORDER BY k) - size AS BIGINT) AS rel_offset, size AS byte_size, CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 28 END AS INTEGER) AS class_id
FROM {_SUPPLY}""")
def directory_scan(spark, sf_dir):
    source = _supplier_files(spark, sf_dir)
    rows = lookups.objects_with_type(tables.objects_table(source), tables.types(source))
    return rows.select("path", "ordinal", "path_id", F.col("rel_offset").cast("long").alias("rel_offset"), "byte_size", "class_id")


@query("""
SELECT n_name AS path, CAST(0 AS INTEGER) AS ordinal, n_name || '/lib' AS path_name, 'archive:/' || n_name AS virtual_path, CAST(n_regionkey AS INTEGER) AS type, CAST(n_nationkey AS BIGINT) AS script_path_id FROM nation""")
def tail_scan(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), "n_regionkey", "n_nationkey")

    def pack(row: dict) -> bytes:
        name = row["path"].encode()
        return encode.serialized_file([(1, HASH, None)], [], b"", [(b"archive:/" + name, HASH, row["n_regionkey"], name + b"/lib")], [(0, row["n_nationkey"])])

    source = _packed(n, pack)
    scripts = tables.scripts(source).select("path", F.col("path_id").alias("script_path_id"))
    return tables.externals(source).join(scripts, "path").select("path", "ordinal", F.decode("path_name", "UTF-8").alias("path_name"), F.decode("virtual_path", "UTF-8").alias("virtual_path"), "type", "script_path_id")


@query("""
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 'resource' WHEN doc_id % 3 = 1 THEN 'serialized-file' ELSE 'deleted' END AS VARCHAR) AS kind,
  CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def archive_scan(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def pack(row: dict) -> bytes:
        k = int(row["path"])
        member = (b"body.resS", 0 if k % 3 == 0 else 4 if k % 3 == 1 else 2, bytes(row["text"]))
        return encode.archive([(b"folder", 1, b""), member], compressed=k % 4 % 3)

    found = tables.members(_packed(d, pack)).where("ordinal = 1")
    return found.select(F.col("path").cast("long").alias("doc_id"), "kind", F.col("size").cast("long").alias("size"), F.sha2("data", 256).alias("sha256"))


_PART = [("Part", "Base", 0, -1, 0), ("SInt64", "key", 1, 8, 0), ("int", "size", 1, 4, 0), ("string", "name", 1, -1, 0), ("Array", "Array", 2, -1, 0x4000), ("int", "size", 3, 4, 0), ("char", "data", 3, 1, 0), ("double", "price", 1, 8, 0)]


def _part_files(spark, sf_dir) -> DataFrame:
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_size", "p_name", "p_retailprice")
    block = {big: encode.schema_block(_PART, big) for big in (False, True)}

    def pack(row: dict) -> bytes:
        big = int(row["path"]) % 2 == 1
        order, name = ">" if big else "<", row["p_name"].encode()
        body = struct.pack(order + "qiI", int(row["path"]), row["p_size"], len(name)) + name
        body += bytes(-len(body) % 4) + struct.pack(order + "d", row["p_retailprice"])
        return encode.serialized_file([(1, HASH, block[big])], [(7, 0, len(body), 0)], body, big=big)

    return _packed(p, pack)


@query("SELECT p_partkey, CAST(p_partkey AS BIGINT) AS key, CAST(p_size AS BIGINT) AS size, p_name AS name, p_retailprice AS price FROM part")
def value_decode(spark, sf_dir):
    v = tables.tree_values(_part_files(spark, sf_dir)).groupBy("path").agg(
        F.max(F.when(F.col("value_path") == "key", F.col("int_value"))).alias("key"), F.max(F.when(F.col("value_path") == "size", F.col("int_value"))).alias("size"),
        F.max(F.when(F.col("value_path") == "name", F.decode("bytes_value", "UTF-8"))).alias("name"), F.max(F.when(F.col("value_path") == "price", F.col("double_value"))).alias("price"))
    return v.select(F.col("path").cast("long").alias("p_partkey"), "key", "size", "name", "price")


@query("""
SELECT p_partkey, x.* FROM part, (VALUES (0, 0, 'Part', 'Base'), (1, 1, 'SInt64', 'key'), (2, 1, 'int', 'size'), (3, 1, 'string', 'name'), (4, 2, 'Array', 'Array'), (5, 3, 'int', 'size'), (6, 3, 'char', 'data'), (7, 1, 'double', 'price')) x(ordinal, level, type_name, field_name)""")
def schema_nodes(spark, sf_dir):
    n = tables.type_nodes(_part_files(spark, sf_dir))
    return n.select(F.col("path").cast("long").alias("p_partkey"), "ordinal", "level", F.decode("type_name", "UTF-8").alias("type_name"), F.decode("field_name", "UTF-8").alias("field_name"))


@query("""
WITH t AS (SELECT r_regionkey, string_agg(n_name || chr(1), '' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
o AS (SELECT r_regionkey, CAST(unnest(range(0, length(names) + 2)) AS BIGINT) AS "offset" FROM t)
SELECT o.r_regionkey, o."offset", CASE WHEN (o."offset" = 0 OR substr(names, o."offset", 1) = chr(1)) AND o."offset" < length(names)
  THEN split_part(substr(names, o."offset" + 1), chr(1), 1) END AS text FROM o JOIN t USING (r_regionkey)""")
def string_resolution(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    table = nation.select("r_regionkey", F.concat(F.array_join("names", "\0"), F.lit("\0")).cast("binary").alias("strings"))
    offsets = table.select("r_regionkey", F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("strings") + F.lit(1).cast("long"))).alias("offset"))
    return lookups.resolve_strings(offsets, table, ["r_regionkey"])


def _line_references(spark, sf_dir, line: DataFrame) -> DataFrame:
    """Pointers of line items to an object of the supplier's file with the supplier's key."""
    supplier = _table(spark, sf_dir, "supplier")
    nodes = supplier.select(F.col("s_suppkey").alias("node"), F.lit("r/f").alias("outer_path"), F.lit(None).cast("string").alias("member_name"), F.lit(False).alias("is_member"), F.lit("r").alias("scope_root"), F.lit(False).alias("has_guid"), F.lit(bytes(16)).alias("guid"))
    objects = supplier.select(F.col("s_suppkey").alias("node"), F.lit(0).alias("ordinal"), F.col("s_suppkey").alias("path_id"), F.lit(5).alias("class_id"))
    externals = spark.createDataFrame([], "node long, ordinal int, virtual_path string, path_name string, guid binary, type int")
    pointers = line.select(
        F.struct("l_orderkey", "l_linenumber").alias("pointer"), F.col("l_suppkey").alias("node"), F.when(F.col("l_linenumber") == 7, -1).otherwise(0).alias("file_id"),
        F.when(F.col("l_partkey") % 11 == 0, 0).otherwise(F.col("l_suppkey") + (F.col("l_partkey") % 3 - 1) * 1000000).alias("path_id"), F.when(F.col("l_linenumber") % 2 == 0, 6).otherwise(5).alias("expected_class"))
    return references.resolve(nodes, objects, externals, pointers).select("pointer.*", "status")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 OR l_suppkey + (l_partkey % 3 - 1) * 1000000 = 0 THEN 'null' WHEN l_linenumber = 7 THEN 'invalid-file-id'
  WHEN l_partkey % 3 <> 1 THEN 'target-missing' WHEN l_linenumber % 2 = 0 THEN 'target-wrong-class' ELSE 'local' END AS status FROM lineitem""")
def local_references(spark, sf_dir):
    return _line_references(spark, sf_dir, _table(spark, sf_dir, "lineitem"))


@query("""
WITH slots AS (SELECT o_custkey % 50 AS host, o_orderkey, o_custkey AS rid FROM orders), rows AS (SELECT c_custkey % 50 AS host, c_custkey AS rid, c_custkey % 4 = 0 AS empty FROM customer WHERE c_custkey % 6 <> 1
  UNION ALL SELECT c_custkey % 50, c_custkey, false FROM customer WHERE c_custkey % 9 = 0),
m AS (SELECT host, rid, count(*) AS n, bool_and(empty) AS empty FROM rows GROUP BY ALL)
SELECT s.o_orderkey, CASE WHEN m.n IS NULL THEN 'missing' WHEN m.n > 1 THEN 'ambiguous' WHEN m.empty THEN 'null' ELSE 'unique' END AS resolution, CAST(coalesce(m.n, 0) AS BIGINT) AS match_count
FROM slots s LEFT JOIN m ON s.host = m.host AND s.rid = m.rid""")
def rid_resolution(spark, sf_dir):
    host = lambda key: [F.lit("f").alias("path"), F.lit(0).alias("member"), (F.col(key) % 50).cast("int").alias("object_ordinal")]
    slots = _table(spark, sf_dir, "orders").select(*host("o_custkey"), F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("rid"))
    c = _table(spark, sf_dir, "customer")
    rows = c.where("c_custkey % 6 <> 1").select(*host("c_custkey"), F.col("c_custkey").alias("ordinal"), F.col("c_custkey").alias("rid"), F.when(F.col("c_custkey") % 4 == 0, "null").otherwise("selected-payload").alias("kind"))
    again = c.where("c_custkey % 9 = 0").select(*host("c_custkey"), (F.col("c_custkey") + 1000000).alias("ordinal"), F.col("c_custkey").alias("rid"), F.lit("selected-payload").alias("kind"))
    found = lookups.resolve_rids(slots, rows.union(again))
    return found.select(F.col("ordinal").alias("o_orderkey"), "resolution", "match_count")


def _registry(spark, sf_dir, keep: str) -> DataFrame:
    """Parts as schema entries: brand and type give the key, the size the schema."""
    b = lambda c: F.col(c).cast("binary")
    rows = _table(spark, sf_dir, "part").where(keep)
    return rows.select(
        F.lit(22).alias("file_version"), b("p_type").alias("engine"), F.length("p_name").alias("class_id"), F.length("p_name").alias("type_id"), F.lit(65535).alias("script_index"),
        F.lit(False).alias("has_script_hash"), F.lit(False).alias("is_stripped"), F.lit(False).alias("is_ref"), F.lit(bytes(16)).alias("script_hash"), b("p_brand").alias("type_hash"),
        F.col("p_size").cast("string").cast("binary").alias("schema"), F.col("p_partkey").cast("string").alias("path"), F.lit(0).alias("member"), F.lit("type").alias("row_kind"), F.lit(0).alias("type_ordinal"))


def _known_schemas(spark, sf_dir, keep: str) -> DataFrame:
    entries = _registry(spark, sf_dir, keep).withColumn("schema", F.lit(None).cast("binary"))
    known = _registry(spark, sf_dir, "p_partkey % 3 = 0")
    keys = [c for c in known.columns if c not in ("schema", "path", "member", "row_kind", "type_ordinal")]
    known = known.groupBy(*keys).agg(F.min(F.col("schema").cast("string").cast("int")).alias("s")).withColumn("schema", F.col("s").cast("string").cast("binary")).drop("s")
    found = lookups.schema_lookup(entries, known)
    return found.select(F.col("path").cast("long").alias("p_partkey"), "found", F.col("found_schema").cast("string").cast("int").alias("size"))


@query("""
WITH known AS (SELECT p_type, length(p_name) AS n, p_brand, min(p_size) AS size FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL)
SELECT p.p_partkey, k.size IS NOT NULL AS found, k.size AS size FROM part p LEFT JOIN known k ON p.p_type = k.p_type AND length(p.p_name) = k.n AND p.p_brand = k.p_brand""")
def registry_lookup(spark, sf_dir):
    return _known_schemas(spark, sf_dir, "true")


@query("""
WITH offers AS (SELECT p_partkey, p_type, length(p_name) AS n, p_brand, p_size FROM part),
agreed AS (SELECT p_type, n, p_brand, min(p_size) <> max(p_size) AS conflict FROM offers GROUP BY ALL)
SELECT o.p_type AS engine, CAST(o.n AS INTEGER) AS class_id, o.p_brand AS type_hash, o.p_size AS size, CASE WHEN conflict THEN 'conflict' ELSE 'learnt' END AS status
FROM offers o JOIN agreed USING (p_type, n, p_brand) GROUP BY ALL""")
def registry_learn(spark, sf_dir):
    entries = _registry(spark, sf_dir, "true")
    learnt = lookups.learn(entries.limit(0), entries)
    return learnt.select(F.decode("engine", "UTF-8").alias("engine"), "class_id", F.decode("type_hash", "UTF-8").alias("type_hash"), F.col("schema").cast("string").cast("int").alias("size"), "status")


@query("""
SELECT c_custkey, CAST(c_custkey * 1000003 AS BIGINT) AS big, CAST(c_custkey * 1000003 AS BIGINT) AS little, -CAST(c_custkey AS BIGINT) AS negative FROM customer""")
def endian_round_trip(spark, sf_dir):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("c_custkey").to_pylist()
            yield pa.record_batch({
                "c_custkey": batch.column("c_custkey"),
                "b": pa.array([struct.pack(">Q", k * 1000003) + struct.pack("<Q", k * 1000003) + struct.pack(">q", -k) for k in keys], pa.binary())})

    rows = _table(spark, sf_dir, "customer").select("c_custkey").mapInArrow(run, "c_custkey long, b binary")
    b = F.col("b")
    return rows.select("c_custkey", binary.unsigned(b, 0, 8).cast("long").alias("big"), binary.unsigned(b, 8, 8, False).cast("long").alias("little"), binary.signed(b, 16, 8).alias("negative"))
