"""The library's operators over the star-schema tables, each with SQL that says the same.

Those tables hold no packaged files: a query here applies one operator's semantics to a
table that carries it.  Byte decoders have no carrier and are covered by unit tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import binary, paths
from quarry.operators import constraints, lookups, trees
from quarry.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f
    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", binary.digest(F.col("text")).alias("digest"))


@query("""
WITH probes AS (SELECT c_custkey AS key FROM customer UNION SELECT c_custkey + 1000000000 FROM customer WHERE c_custkey % 7 = 0),
targets AS (SELECT o_custkey AS key, o_orderkey FROM orders),
ranked AS (SELECT key, o_orderkey, row_number() OVER (PARTITION BY key ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY key) AS n FROM targets)
SELECT p.key, CASE WHEN max(r.n) IS NULL THEN 'missing' WHEN max(r.n) = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome,
  CAST(coalesce(max(r.n), 0) AS BIGINT) AS match_count, max(CASE WHEN rn = 1 THEN o_orderkey END) AS first, max(CASE WHEN rn = 2 THEN o_orderkey END) AS second
FROM probes p LEFT JOIN ranked r ON p.key = r.key GROUP BY p.key""")
def lookup_trichotomy(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    absent = customers.where("key % 7 = 0").select((F.col("key") + 1000000000).alias("key"))
    targets = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    return lookups.trichotomy(customers.union(absent), targets, ["key"], "o_orderkey")


@query("""
WITH r AS (SELECT doc_id, source, doc_id * 200 AS start, n_chars AS size FROM documents WHERE n_chars > 0),
w AS (SELECT *, max(start + size) OVER (PARTITION BY source ORDER BY start, start + size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end FROM r)
SELECT doc_id, source, start, size, previous_end FROM w WHERE previous_end > start""")
def range_overlap(spark, sf_dir):
    ranges = _table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") * 200).alias("start"), F.col("n_chars").alias("size"))
    return constraints.overlaps(ranges, ["source"], "start", "size")


@query("""
SELECT path, bool_or(explicit_file) AS explicit_file FROM (
  SELECT n_name AS path, n_regionkey = 1 AS explicit_file FROM nation
  UNION ALL SELECT n_name, n_regionkey > 2 FROM nation WHERE n_nationkey % 2 = 0) GROUP BY path""")
def path_merge(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    one = nation.select(F.col("n_name").alias("path"), (F.col("n_regionkey") == 1).alias("explicit_file"))
    other = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("path"), (F.col("n_regionkey") > 2).alias("explicit_file"))
    return constraints.merge_paths(one, other)


@query("SELECT l_orderkey, l_linenumber % 3 AS slot, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("slot"))
    return constraints.duplicates(rows, "l_orderkey", "slot")


@query("""SELECT p_partkey, p_name GLOB '*[a-f]?[!aeiou]*' AS few_stars, p_name GLOB '*r*d* *i*g*' AS many_stars, regexp_matches(p_name, '^.* (ring|bolt)$') AS escaped FROM part""")
def glob_filter(spark, sf_dir):
    name = F.col("p_name")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", paths.glob(name, "*[a-f]?[!aeiou]*").alias("few_stars"), paths.glob(name, "*r*d* *i*g*").alias("many_stars"),
        (paths.glob(name, r"*\ ring") | paths.glob(name, r"*\ [b]olt")).alias("escaped"))


_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT page_id, CASE
  WHEN path = '' THEN 'empty'
  WHEN path LIKE '/%' OR path LIKE '%/' OR path LIKE '%//%' THEN 'empty-component'
  WHEN regexp_matches(path, '(^|/)\\.\\.?(/|$)') THEN 'dot-component'
  WHEN contains(path, chr(92)) THEN 'backslash'
  WHEN regexp_matches(path, '[\\x00-\\x1f]') THEN 'control-character' ELSE 'ok' END AS status,
  CASE WHEN path = '' THEN 'empty' WHEN path LIKE '/%' OR path LIKE '%/' OR path LIKE '%//%' THEN 'empty-component' ELSE 'ok' END AS checked
FROM p""")
def path_status(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", paths.relative_path_status(F.col("path")).alias("status"), paths.relative_path_check(F.col("path"))["status"].alias("checked"))


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), r AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM p)
SELECT r.root, count(*) AS n FROM r JOIN p ON r.root <> '' AND (p.path = r.root OR starts_with(p.path, r.root || '/')) GROUP BY r.root""")
def descendant_pairs(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    # A root is the first component, so the pairs are an equi-join that the predicate confirms.
    keyed = rows.withColumn("head", F.substring_index("path", "/", 1))
    roots = keyed.select(F.col("head").alias("root")).distinct()
    return keyed.join(roots, F.col("head") == F.col("root")).where(paths.is_within(F.col("path"), F.col("root"))).groupBy("root").agg(F.count("*").alias("n"))


_TREE = """
WITH rows AS (
  SELECT 0 AS a, 0 AS b, 0 AS level UNION ALL SELECT r_regionkey + 1, 0, 1 FROM region UNION ALL SELECT n_regionkey + 1, n_nationkey + 1, 2 FROM nation),
nodes AS (SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS ordinal, level FROM rows)"""


@query(_TREE + """
, up AS (SELECT x.ordinal, x.level, max(y.ordinal) AS parent FROM nodes x LEFT JOIN nodes y ON y.ordinal < x.ordinal AND y.level = x.level - 1 GROUP BY ALL),
ends AS (SELECT x.ordinal, coalesce(min(y.ordinal), (SELECT count(*) FROM nodes)) AS subtree_end FROM nodes x LEFT JOIN nodes y ON y.ordinal > x.ordinal AND y.level <= x.level GROUP BY ALL),
kids AS (SELECT parent AS ordinal, min(ordinal) AS first_child, count(*) AS child_count FROM up WHERE parent IS NOT NULL GROUP BY ALL)
SELECT u.ordinal, u.level, u.parent, k.first_child, CASE WHEN u.parent IS NOT NULL THEN lead(u.ordinal) OVER (PARTITION BY u.parent ORDER BY u.ordinal) END AS next_sibling,
  CAST(coalesce(k.child_count, 0) AS INTEGER) AS child_count, CAST(e.subtree_end AS INTEGER) AS subtree_end
FROM up u JOIN ends e USING (ordinal) LEFT JOIN kids k USING (ordinal)""")
def tree_links(spark, sf_dir):
    return trees.links(_levels(spark, sf_dir), ["tree"]).drop("tree")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as one tree in preorder."""
    i = lambda c: F.col(c).cast("int")
    root = spark.range(1).select(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("level"))
    regions = _table(spark, sf_dir, "region").select((i("r_regionkey") + 1).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("level"))
    nations = _table(spark, sf_dir, "nation").select((i("n_regionkey") + 1).alias("a"), (i("n_nationkey") + 1).alias("b"), F.lit(2).alias("level"))
    rows = root.union(regions).union(nations)
    return rows.select(F.lit(0).alias("tree"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("a", "b")) - 1).alias("ordinal"), "level")


@query(_TREE + """
, w AS (SELECT ordinal, CASE WHEN ordinal % 5 = 3 THEN level + 2 ELSE level END AS level FROM nodes),
s AS (SELECT ordinal, level, lag(level) OVER (ORDER BY ordinal) AS before FROM w)
SELECT ordinal, level FROM s WHERE CASE WHEN before IS NULL THEN level <> 0 ELSE level < 1 OR level > before + 1 END""")
def hierarchy_errors(spark, sf_dir):
    nodes = _levels(spark, sf_dir).withColumn("level", F.when(F.col("ordinal") % 5 == 3, F.col("level") + 2).otherwise(F.col("level")))
    return trees.hierarchy_errors(nodes, ["tree"]).select("ordinal", "level")


@query("""
SELECT CAST(user_id % 10 AS BIGINT) AS shard, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'purchase') AS purchase
FROM events GROUP BY ALL""")
def member_counts(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("shard", F.col("user_id") % 10)
    return constraints.counts_by_kind(rows, "event_type", ["click", "view", "purchase"], "shard")


@query("""
SELECT page_id, CASE WHEN substr(h, 1, 16) = '556E697479465300' THEN 'archive' WHEN n < 20 OR v < 1 OR v > 100 THEN 'unrelated'
  WHEN v <> 22 AND NOT z THEN 'unrelated' ELSE 'unsupported-serialized-file' END AS kind
FROM (SELECT page_id, hex(encode(html)) AS h, octet_length(encode(html)) AS n, CAST('0x' || substr(hex(encode(html)), 17, 8) AS BIGINT) AS v,
  substr(hex(encode(html)), 33, 8) IN ('00000000', '01000000') AS z FROM pages)""")
def probe_kind(spark, sf_dir):
    content = F.col("html").cast("binary")
    return _table(spark, sf_dir, "pages").select("page_id", files.probe(content)["kind"].alias("kind"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def first_match(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("ordinal", F.struct("o_orderdate", "o_orderkey"))
    return lookups.first_match(rows, ["o_custkey"], "ordinal").drop("ordinal")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE
  WHEN l_linenumber & 4 <> 0 THEN CASE WHEN l_linenumber & 3 <> 0 THEN 'invalid' ELSE 'serialized-file' END
  WHEN l_linenumber & 1 <> 0 THEN CASE WHEN l_linenumber & 2 <> 0 THEN 'invalid' ELSE 'directory' END
  WHEN l_linenumber & 2 <> 0 THEN 'deleted' ELSE 'resource' END AS kind FROM lineitem""")
def flag_decode(spark, sf_dir):
    kind = constraints.member_class(F.col("l_linenumber"), F.lit("level0.resS"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", kind.alias("kind"))


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM orders)
SELECT o_custkey, min(o_orderkey) AS row, CAST(arg_min(total, o_orderkey) AS BIGINT) AS total FROM w WHERE total > 500000 GROUP BY o_custkey""")
def running_limits(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("amount"))
    return constraints.running_total_violations(rows, ["o_custkey"], "o_orderkey", "amount", 500000)


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS n, min(o_orderkey) FILTER (o_orderstatus = 'P') AS ordinal,
  CASE count(*) FILTER (o_orderstatus = 'P') WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'duplicate' END AS status FROM orders GROUP BY o_custkey""")
def single_object(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").withColumn("ordinal", F.col("o_orderkey"))
    return constraints.exactly_one(rows, F.col("o_orderstatus") == "P", "o_custkey")


@query("""
SELECT c_custkey, lower(c_mktsegment) = 'building' AS is_building, translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM customer""")
def ascii_casecmp(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", binary.equals_ignoring_ascii_case(F.col("c_mktsegment"), F.lit("Building")).alias("is_building"), binary.ascii_fold(F.col("c_name")).alias("folded"))


@query("""
SELECT page_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS be32, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS le32,
  CAST('0x' || substr(h, 1, 4) AS BIGINT) AS be16 FROM (SELECT page_id, hex(encode(html)) AS h FROM pages WHERE octet_length(encode(html)) >= 4)""")
def endian_reads(spark, sf_dir):
    data = F.col("html").cast("binary")
    rows = _table(spark, sf_dir, "pages").where(F.octet_length("html") >= 4)
    return rows.select("page_id", binary.unsigned(data, 0, 4).alias("be32"), binary.unsigned(data, 0, 4, big=False).alias("le32"), binary.unsigned(data, 0, 2).alias("be16"))


@query("""
SELECT w.nation, CASE WHEN e.digest IS NULL THEN 'missing' WHEN e.digest = w.digest THEN 'unchanged' ELSE 'collision' END AS status
FROM (SELECT n_name AS nation, sha256(n_name) AS digest FROM nation) w
LEFT JOIN (SELECT n_name AS nation, CASE WHEN n_nationkey % 3 = 1 THEN sha256('x' || n_name) ELSE sha256(n_name) END AS digest FROM nation WHERE n_nationkey % 4 <> 0) e USING (nation)""")
def publish_preflight(spark, sf_dir):
    from quarry.publish import preflight

    nation = _table(spark, sf_dir, "nation")
    wanted = nation.select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"))
    other = F.when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("x"), "n_name")).otherwise(F.col("n_name"))
    existing = nation.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("path"), F.sha2(other, 256).alias("sha256"))
    return preflight(wanted, existing).withColumnRenamed("path", "nation")


@query("SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY encode(n_name)")
def object_with_type(spark, sf_dir):
    types = _table(spark, sf_dir, "region").select(F.lit("f").alias("path"), F.lit(0).alias("member"), F.col("r_regionkey").alias("ordinal"), F.col("r_regionkey").alias("class_id"), F.col("r_name").alias("script_index"))
    objects = _table(spark, sf_dir, "nation").select(F.lit("f").alias("path"), F.lit(0).alias("member"), F.col("n_regionkey").alias("type_ordinal"), "n_name")
    return lookups.objects_with_type(objects, types).select(F.col("script_index").alias("r_name"), "n_name").orderBy(F.col("n_name").cast("binary"))
