import os

import pytest
from builders import SIMPLE, bundle, serialized, simple_payload
from pyspark.sql import functions as F
from test_decode import alpha, entry_of, managed_file, ordinary_file, sample, settings_payload

from quarry import publish
from quarry.decode import build_settings
from quarry.decode.cursor import Reject
from quarry.operators import constraints, lookups, references, trees
from quarry.plans import report
from quarry.sources import discovery, files, tables
from quarry.streaming import incremental


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("assets")
    body = simple_payload(1, b"a", b"z")
    one = [dict(class_id=49, nodes=SIMPLE)]
    plain = [dict(class_id=49)]
    found = {
        "good": sample(), "twice": serialized(plain, [(1, 0, 4, 0), (1, 4, 4, 0)], bytes(8)), "over": serialized(plain, [(1, 0, 8, 0), (2, 4, 4, 0), (3, 6, 0, 0)], bytes(8)),
        "cut": sample()[:-1], "note.txt": b"nothing here to see at all", "pack": bundle([(b"in", 4, serialized(one, [(5, 0, len(body), 0)], body)), (b"x.resS", 0, b"r"), (b"d", 1, b"")], 2),
        "_hidden": ordinary_file(), "managed": managed_file([(-2, "", "", "", b""), (1, "Alpha", "N", "A", alpha(7, b"x", 3))], 1, 9),
        "settings": serialized([dict(class_id=141, type_hash=build_settings.TYPE_HASH)], [(1, 0, len(settings_payload()), 0)], settings_payload()),
    }
    for name, data in found.items():
        (top / name).write_bytes(data)
    (top / "sub").mkdir()
    (top / "sub" / "deep").write_bytes(b"x")
    os.symlink(top / "good", top / "link")
    return str(top)


def name_of(path):
    return path.rsplit("/", 1)[-1]


def test_discovery(folder):
    found = discovery.discover([folder, f"{folder}/good"])
    assert [name_of(p) for p, _ in found] == sorted(["good", "twice", "over", "cut", "note.txt", "pack", "_hidden", "managed", "settings", "deep"], key=lambda n: ("sub/" if n == "deep" else "") + n)
    assert [name_of(p) for p, explicit in found if explicit] == ["good"]
    for inputs, options, status in (
        ([f"{folder}/link"], {}, "link-rejected"), ([folder], {"reject_links": True}, "link-rejected"), ([folder], {"max_files": 3}, "file-limit-exceeded"), ([], {}, "invalid-argument"),
        ([f"{folder}/none"], {}, "not-found"), ([folder], {"max_directories": 1}, "directory-limit-exceeded"), ([folder], {"max_path_bytes": 5}, "path-limit-exceeded"), (["/dev/null"], {}, "unsupported-node"),
    ):
        with pytest.raises(Reject) as e:
            discovery.discover(inputs, discovery.Options(**options))
        assert e.value.status == status
    assert all("deep" not in p for p, _ in discovery.discover([folder], discovery.Options(recursive=False)))


def test_program_resource(tmp_path):
    (tmp_path / "share").mkdir()
    (tmp_path / "share" / "f").write_bytes(b"")
    assert discovery.program_resource("f", str(tmp_path / "prog")) == str(tmp_path / "share" / "f")
    for name in ("", "g", "../f", "/f"):
        with pytest.raises(Reject):
            discovery.program_resource(name, str(tmp_path / "prog"))


def test_probe_column_equals_decoder(spark, folder):
    from quarry.decode.container import probe

    rows = {r.path: r for r in report.probed(spark, [folder]).collect()}
    assert len(rows) == 10
    whole = files.listed_files(spark, [folder])
    for r in whole.collect():
        found = rows[r.path.replace("file:/", "file:///").replace("file://///", "file:///")]
        assert (found.kind, found.serialized_version) == probe(bytes(r.content)[:96], r.length), r.path
        assert found.content is None or (bytes(found.content), found.sha256) == (bytes(r.content), r.sha256)
    assert {r.status for r in files.revalidate(whole).collect()} == {"unchanged"}
    gone = spark.createDataFrame([(f"file://{folder}/nothing", "0"), (f"file://{folder}/good", "0")], "path string, sha256 string")
    assert sorted(r.status for r in files.revalidate(gone).collect()) == ["changed", "missing"]
    kept = files.listed_files(spark, [folder], 200)
    assert {name_of(r.path) for r in kept.collect()} >= {"note.txt"} and kept.agg(F.max("length")).first()[0] <= 200


def test_structure_report(spark, folder):
    got = {(name_of(r.path), r.member): r for r in report.structure_report(spark, [folder]).collect()}
    assert got["good", 0].accepted and got["good", 0].n_objects == 3
    assert (got["twice", 0].duplicate_ids, got["twice", 0].overlapping, got["twice", 0].accepted) == (1, 0, False)
    assert (got["over", 0].duplicate_ids, got["over", 0].overlapping, got["over", 0].accepted) == (0, 1, False)
    assert got["pack", 0].member_name == "in" and got["pack", 0].accepted
    assert ("cut", 0) not in got
    # A managed registry has a leaf without a wire rule, which only the typed decoders know.
    assert {name_of(r.path) for r in report.accepted_sources(spark, [folder]).collect()} == {"good", "pack", "_hidden"}
    members = report.member_report(spark, [folder]).first()
    assert (members.serialized_file, members.resource, members.directory, members.invalid) == (1, 1, 1, 0)


def test_tables(spark, folder):
    source = tables.sources(report.probed(spark, [folder]))
    only = lambda df, name: df.where(F.col("path").endswith(name))
    assert only(tables.externals(source), "good").count() == 2 and only(tables.scripts(source), "good").first().path_id == 77
    assert only(tables.headers(source), "good").first().target == 19
    sliced = only(tables.payloads(tables.objects_table(source), source), "good").orderBy("ordinal").collect()
    assert [bytes(r.payload) for r in sliced] == [simple_payload(-5, b"abc", b"\x01\x02")] * 2 + [b""]
    refs = only(tables.ref_types(source), "good").first()
    assert bytes(refs.class_name) == b"C"
    values = only(tables.tree_values(source), "good")
    assert {r.value_path: (r.int_value, r.bytes_value) for r in values.where("object_ordinal = 0").collect()}["number"] == (-5, None)
    assert values.where("value_digest IS NOT NULL").select("value_digest").distinct().count() == 1
    assert only(tables.values(source), "_hidden").groupBy("path_id").count().orderBy("path_id").collect() == [(1, 3), (2, 10), (3, 12)]
    settings = {name_of(r.path): r.status for r in tables.build_settings_table(source).collect()}
    assert settings["settings"] == "ok" and settings["good"] == "build-settings-missing"
    shapes = only(tables.shapes(source), "good")
    assert shapes.count() == 3 and shapes.where("grammar_error IS NOT NULL OR profile <> 'unknown'").count() == 0
    archives = report.probed(spark, [folder]).where("kind = 'archive'")
    region = tables.archives(archives).join(tables.archive_blocks(archives).groupBy("path").agg(F.sum("csize").alias("r")), "path")
    assert constraints.block_coverage(region, tables.archive_blocks(archives), F.col("r")).first().covered
    slots = lookups.resolve_rids(tables.rid_slots(source), tables.registry_rows(source)).orderBy("ordinal").collect()
    assert [(s.rid, s.resolution) for s in slots] == [(1, "unique"), (9, "missing"), (3, "missing")]
    assert lookups.rid_totals(lookups.resolve_rids(tables.rid_slots(source), tables.registry_rows(source))).first().missing == 2
    assert tables.managed_values(source).count() == 23


def test_rids_null_and_ambiguous(spark):
    host = "path string, member int, object_ordinal int"
    slots = spark.createDataFrame([("p", 0, 0, k, rid) for k, rid in enumerate((-2, 5, 6, 5))] + [("q", 0, 0, 0, 6)], f"{host}, ordinal int, rid long")
    rows = spark.createDataFrame([("p", 0, 0, 0, -2, "null"), ("p", 0, 0, 1, 5, "selected-payload"), ("p", 0, 0, 2, 5, "selected-payload")], f"{host}, ordinal int, rid long, kind string")
    got = {(r.path, r.ordinal): (r.resolution, r.match_count, r.first_row, r.second_row) for r in lookups.resolve_rids(slots, rows).collect()}
    assert got == {("p", 0): ("null", 1, 0, None), ("p", 1): ("ambiguous", 2, 1, 2), ("p", 2): ("missing", 0, None, None), ("p", 3): ("ambiguous", 2, 1, 2), ("q", 0): ("missing", 0, None, None)}


def test_strings_resolve_at_starts_only(spark):
    t = spark.createDataFrame([(1, bytearray(b"ab\0\0cd\0x"))], "k int, strings binary")
    o = spark.createDataFrame([(1, n) for n in range(9)], "k int, offset long")
    assert {r.offset: r.text for r in lookups.resolve_strings(o, t, ["k"]).collect() if r.text is not None} == {0: "ab", 3: "", 4: "cd"}


def test_trees(spark, folder):
    source = tables.sources(report.probed(spark, [folder]))
    keys = ["path", "member", "row_kind", "type_ordinal"]
    nodes = tables.type_nodes(source)
    linear = trees.links(nodes, keys)
    columns = [*keys, "ordinal", "parent", "first_child", "next_sibling", "child_count", "subtree_end"]
    relational = trees.links_by_join(nodes, keys)
    cast = lambda df: df.select(*(F.col(c).cast("string").alias(c) for c in columns))
    assert cast(linear).exceptAll(cast(relational)).count() == 0 and linear.count() == relational.count() == nodes.count()
    context = {(name_of(r.path), r.row_kind): r for r in trees.contexts(linear, keys).collect()}
    assert context["managed", "type"].registry == 25 and context["managed", "type"].ordinary_end == 46 and context["managed", "type"].selected_end == 25
    assert context["good", "type"].registry is None and context["good", "type"].selected_end == 10
    assert trees.hierarchy_errors(nodes, keys).count() == 0


def test_registry_operators(spark, tmp_path):
    path = str(tmp_path / "schemas.bin")
    entries = [entry_of(SIMPLE, k) for k in (3, 5)]
    (tmp_path / "first").write_bytes(b"")
    registry_rows = publish.registry.serialize(entries)
    open(path, "wb").write(registry_rows)
    known = publish.import_registry(spark, path)
    assert publish.export_registry(known, str(tmp_path / "again.bin")) == 2 and (tmp_path / "again.bin").read_bytes() == registry_rows

    def source_of(*datas):
        return spark.createDataFrame([(f"f{k}", 0, bytearray(d)) for k, d in enumerate(datas)], "path string, member int, data binary")

    bare = source_of(serialized([dict(class_id=3), dict(class_id=5)], [], b""), serialized([dict(class_id=3), dict(class_id=9)], [], b""))
    assert {r.path: (r.resolved, r.missing) for r in lookups.resolved_sources(tables.schema_entries(bare), known).collect()} == {"f0": (True, 0), "f1": (False, 1)}
    part = lookups.resolve_class(tables.schema_entries(bare), known, 3)
    assert {(r.path, r.class_id): r.schema is not None for r in part.collect()} == {("f0", 3): True, ("f0", 5): False, ("f1", 3): True, ("f1", 9): False}
    other = [*SIMPLE[:1], ("int", "renamed", 1, 0, 4, 0)]
    full = source_of(
        serialized([dict(class_id=3, nodes=SIMPLE), dict(class_id=8, nodes=SIMPLE)], [], b""), serialized([dict(class_id=5, nodes=other), dict(class_id=6, nodes=SIMPLE)], [], b""))
    got = sorted((r.class_id, r.status) for r in lookups.learn(known, tables.schema_entries(full)).collect())
    assert got == [(3, "known"), (5, "conflict"), (5, "known"), (8, "learnt")]
    reg = known.withColumn("shape_digest", F.lit("d"))
    wanted = known.withColumn("engine", F.lit(b"2021.3.29f1")).unionByName(known.where("class_id = 3")).unionByName(known.where("class_id = 3").withColumn("class_id", F.lit(99)))
    profiles = spark.createDataFrame([(bytearray(b"2021.3.29f1"), 3, bytearray(b"h" * 16), "d")], "engine binary, class_id int, type_hash binary, shape_digest string")
    bound = sorted((bytes(r.engine).decode()[-3:], r.class_id, r.status, r.schema is not None) for r in lookups.bind_version(reg, wanted, profiles).collect())
    assert bound == [("5f1", 3, "ok", False), ("5f1", 99, "not-found", False), ("9f1", 3, "ok", True), ("9f1", 5, "invalid-schema", False)]


ZERO, G1, G2 = bytes(16), b"1" * 16, b"2" * 16
EXTRA = bytes(8) + b"\x0f" + bytes(7)
NODES = [  # node, outer, member, is_member, root, has_guid, guid
    (0, "r/a/b/src", None, False, "r", False, ZERO), (1, "r/a/lib", None, False, "r", True, G1), (2, "r/lib", None, False, "r", True, G2), (3, "r/a/twin", None, False, "r", False, ZERO),
    (4, "r/a/./twin", None, False, "r", False, ZERO), (5, "r/pack", "in/one", True, "r", False, ZERO), (6, "r/pack", "in/./two", True, "r", False, ZERO), (7, "r/other", "in/two", True, "r", False, ZERO),
    (8, "r/Resources/unity_builtin_extra", None, False, "r", False, ZERO), (9, "q/lib2", None, False, "q", False, ZERO), (10, "r/same", "m", True, "r", False, ZERO), (11, "r/same", "m", True, "r", False, ZERO),
    (12, "r/same", "s", True, "r", False, ZERO), (13, "r2/outside", None, False, "r", False, ZERO)]
EXTERNALS = {0: [("", ZERO, 0, "lib"), ("", G2, 0, "lib"), ("", ZERO, 0, "twin"), ("x", ZERO, 0, "lib"), ("", ZERO, 0, ""), ("", ZERO, 0, "lib2"), ("", EXTRA, 0, "Resources/unity_builtin_extra"),
                 ("", ZERO, 0, "Resources/unity_builtin_extra"), ("", ZERO, 0, "/r/lib"), ("", ZERO, 0, "../../lib"), ("archive:/in/two", ZERO, 0, "archive:/in/two"), ("", G1, 0, "twin")],
             5: [("archive:/in", ZERO, 0, "two"), ("", ZERO, 0, "archive:/in/none"), ("archive:/in/two", ZERO, 0, "archive:/in//two"), ("archive:/a", ZERO, 0, "archive:/b")], 12: [("", ZERO, 0, "archive:/m")], 13: [("", ZERO, 0, "lib")]}
CASES = [  # node, file, path id, class, status, target
    (0, 5, 0, None, "null", None), (0, -1, 1, None, "invalid-file-id", None), (0, 99, 1, None, "invalid-file-id", None), (0, 0, 1, None, "local", 0), (0, 0, 2, None, "target-missing", 0), (0, 0, 1, 7, "target-wrong-class", 0),
    (0, 1, 1, 4, "external-exact", 1), (0, 2, 1, None, "external-exact", 2), (0, 3, 1, None, "ambiguous", None), (0, 4, 1, None, "out-of-scope", None), (0, 5, 1, None, "out-of-scope", None), (0, 6, 1, None, "out-of-scope", None),
    (0, 7, 1, None, "external-builtin-contract", 8), (0, 8, 1, None, "out-of-scope", None), (0, 9, 1, None, "out-of-scope", None), (0, 10, 1, None, "external-exact", 2), (0, 11, 1, None, "out-of-scope", None), (0, 12, 1, None, "out-of-scope", None),
    (5, 1, 1, None, "external-exact", 6), (5, 2, 1, None, "out-of-scope", None), (5, 3, 1, None, "external-exact", 6), (5, 4, 1, None, "out-of-scope", None), (12, 1, 1, None, "ambiguous", None), (13, 1, 1, None, "out-of-scope", None)]


def test_references(spark):
    b = bytearray
    nodes = spark.createDataFrame([(*n[:6], b(n[6])) for n in NODES], "node int, outer_path string, member_name string, is_member boolean, scope_root string, has_guid boolean, guid binary")
    objects = spark.createDataFrame([(n[0], 0, 1, 4) for n in NODES] + [(0, 1, 1, 7)], "node int, ordinal int, path_id long, class_id int")
    externals = spark.createDataFrame([(n, k, v, p, b(g), t) for n, rows in EXTERNALS.items() for k, (v, g, t, p) in enumerate(rows)], "node int, ordinal int, virtual_path string, path_name string, guid binary, type int")
    pointers = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(CASES)], "pointer int, node int, file_id int, path_id long, expected_class int")
    got = {r.pointer: (r.status, r.target) for r in references.resolve(nodes, objects, externals, pointers).collect()}
    assert {k: (CASES[k][:4], v) for k, v in got.items()} == {k: (c[:4], (c[4], c[5])) for k, c in enumerate(CASES)}


def test_publish(tmp_path):
    path = str(tmp_path / "f")
    assert publish.preflight_file(path, b"a") == "missing" and publish.publish_exact(path, b"a") == "emitted"
    assert publish.publish_exact(path, b"a") == "unchanged" and publish.publish_exact(path, b"b") == "collision" and open(path, "rb").read() == b"a"
    assert publish.write_new(path, b"c") == "already-exists" and os.listdir(tmp_path) == ["f"]
    assert publish.publish_exact(str(tmp_path / "no" / "f"), b"a") == "io-error"
    assert publish.residue_possible("missing", "io-error", "unchanged") and not publish.residue_possible("missing", "emitted", "unchanged")
    assert publish.run_process(["true"], 5) == ("ok", 0) and publish.run_process(["sleep", "9"], 0.1) == ("timed-out", None)
    assert publish.run_process(["/no/such"], 1) == ("not-started", None) and publish.run_process([], 1)[0] == "invalid-argument"


def test_streaming_ingest(spark, folder, tmp_path):
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    stream = incremental.arriving_files(spark, folder)
    incremental.ingest(stream, target, checkpoint).awaitTermination(120)
    got = spark.read.parquet(f"{target}/objects")
    assert got.where(F.col("path").endswith("/good")).count() == 3
    query = incremental.counts_by_window(stream).writeStream.format("memory").queryName("arrivals").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("arrivals").agg(F.sum("n")).first()[0] >= 9


def test_discovery_by_uri(spark, tmp_path):
    import pytest

    from quarry.decode.cursor import Reject
    from quarry.sources import discovery, files

    for name in ("b/two", "a", "b/_hidden"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    want = [f"file:{tmp_path}/{n}" for n in ("a", "b/_hidden", "b/two")]
    assert discovery.discover_shared(spark, [f"file://{tmp_path}"]) == [(p, False) for p in want]
    assert discovery.discover_shared(spark, [f"file:{tmp_path}/a", f"file:{tmp_path}"])[0] == (want[0], True)
    assert [p for p, _ in discovery.discover_shared(spark, [f"file:{tmp_path}"], discovery.Options(recursive=False))] == want[:1]
    assert sorted(r.content for r in files.listed_files(spark, [f"file://{tmp_path}"]).collect()) == [b"a", b"b/_hidden", b"b/two"]
    assert sorted(r.content for r in files.listed_files(spark, [str(tmp_path)]).collect()) == [b"a", b"b/_hidden", b"b/two"]
    for inputs, options in (([f"file:{tmp_path}/none"], {}), ([f"file:{tmp_path}"], {"max_files": 2}), ([f"file:{tmp_path}"], {"max_directories": 1}), ([], {})):
        with pytest.raises(Reject):
            discovery.discover_shared(spark, inputs, discovery.Options(**options))


def test_visitor(spark):
    import pytest

    from quarry.sources import tables

    source = spark.createDataFrame([("p", 0, bytearray(b"abc")), ("q", 1, bytearray(b""))], "path string, member int, data binary")
    got = tables.visit(source, lambda row: [{"n": len(row["data"])}] if row["data"] else None, "n int").collect()
    assert [tuple(r) for r in got] == [("p", 0, 3)]
    with pytest.raises(Exception, match="visitor-failed"):
        tables.visit(source, lambda row: bool(row["data"])).collect()
