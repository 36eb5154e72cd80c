import struct

import pytest
from builders import SIMPLE, Out, bundle, lz4_literals, serialized, simple_payload, tree

from quarry.decode import archive, build_settings, container, objects, registry, schema
from quarry.decode.cursor import Cursor, Reject
from quarry.decode.legacy import read_type


def sample(big=False):
    body = simple_payload(-5, b"abc", b"\x01\x02", big)
    guid = bytes(range(16))
    return serialized(
        [dict(class_id=49, nodes=SIMPLE, deps=(3, -1)), dict(class_id=114, script_index=0, nodes=SIMPLE)],
        [(10, 0, len(body), 0), (-3, len(body), len(body), 1), (9, 2 * len(body), 0, 0)], body * 2,
        scripts=[(0, 77)], externals=[(b"", guid, 0, b"lib/other"), (b"archive:/a", guid, 2, b"b")],
        refs=[dict(class_id=-1, script_index=1, nodes=SIMPLE, reference=("C", "N", "A"))], user=b"note", big=big)


@pytest.mark.parametrize("big", [False, True])
def test_file_round_trip(big):
    f = container.decode(sample(big))
    assert [(t["class_id"], t["script_index"], t["node_count"], t["dependencies"]) for t in f.types] == [(49, -1, 10, [3, -1]), (114, 0, 10, [])]
    assert [t["script_hash"] for t in f.types] == [None, b"s" * 16]
    assert [(o["path_id"], o["type_ordinal"]) for o in f.objects] == [(10, 0), (-3, 1), (9, 0)]
    assert f.scripts[0]["path_id"] == 77 and f.externals[1]["virtual_path"] == b"archive:/a" and f.externals[0]["path_name"] == b"lib/other"
    assert (f.ref_types[0]["class_name"], f.ref_types[0]["assembly"], f.user_information) == (b"C", b"A", b"note")
    assert container.semantic_errors(f) == []


def test_every_truncation_is_refused():
    data = sample()
    for n in range(len(data)):
        with pytest.raises(Reject):
            container.decode(data[:n])
    packed = bundle([(b"a", 4, data[:50]), (b"b.resS", 0, b"xyz" * 9)], 2)
    for n in range(len(packed)):
        with pytest.raises(Reject):
            archive.open_archive(packed[:n])


def test_refusals_say_what_and_where():
    data = bytearray(sample())
    cases = [(8, 0, "unsupported-version"), (40, 2, "unsupported-endian"), (31, 1, "malformed-layout"), (58, ord("0"), "unsupported-engine-version"), (64, 3, "unsupported-tree-flag")]
    for at, value, status in cases:
        bad = bytearray(data)
        bad[at] = value
        if at == 8:
            bad[11] = 21
        with pytest.raises(Reject) as e:
            container.decode(bytes(bad))
        assert e.value.status == status, at
    with pytest.raises(Reject) as e:
        container.decode(serialized([dict(class_id=-1)], [], b""))
    assert e.value.status == "unsupported-type-shape"
    with pytest.raises(Reject) as e:
        container.decode(serialized([dict(class_id=1)], [(1, 0, 9, 0)], b"12345678"))
    assert (e.value.status, e.value.field, e.value.row) == ("malformed-metadata", "object-range", 0)
    with pytest.raises(Reject) as e:
        container.decode(serialized([dict(class_id=1)], [(1, 0, 1, 1)], b"12345678"))
    assert e.value.field == "object-type"
    grown = sample()
    assert container.decode(grown).header["tree_raw"] == 1


def test_probe():
    data = sample()
    assert container.probe(data[:96], len(data)) == ("serialized-file", 22)
    assert container.probe(data[:96], len(data) + 1) == ("unsupported-serialized-file", 22)
    assert container.probe(b"UnityFS\0rest", 12)[0] == "archive"
    assert container.probe(b"UnityWeb\0rest", 13)[0] == "unsupported-archive"
    assert container.probe(b"plain text that is long enough", 30)[0] == "unrelated"
    old = bytes(8) + struct.pack(">I", 17) + bytes(8)
    assert container.probe(old, 20) == ("unsupported-serialized-file", 17)
    assert container.probe(old[:16] + b"\2\0\0\0", 20)[0] == "unrelated"


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
@pytest.mark.parametrize("at_end,padded", [(False, False), (True, False), (False, True)])
def test_archives(kind, at_end, padded):
    members = [(b"level", 4, sample()), (b"x.resource", 0, b"r" * 300), (b"d", 1, b""), (b"gone", 2, b""), (b"odd", 0, b"?")]
    found = archive.open_archive(bundle(members, kind, at_end, padded))
    assert [(m["name"], m["data"]) for m in found["members"]] == [(n, d) for n, _, d in members]
    assert [m["kind"] for m in found["members"]] == ["serialized-file", "resource", "directory", "deleted", "invalid"]


def test_lz4():
    assert archive.lz4(lz4_literals(b"x" * 600), 600, exact=True) == b"x" * 600
    block = bytes([0x14]) + b"a" + b"\x01\x00" + bytes([0x50]) + b"bcdef"
    assert archive.lz4(block, 14, exact=True) == b"a" * 9 + b"bcdef"
    for bad, room in [(block, 13), (b"\x10a\x00\x00", 9), (b"\x10a\x02\x00", 9), (b"\xf0", 99), (b"\x10", 9), (b"\x14a\x01", 9)]:
        with pytest.raises(Reject):
            archive.lz4(bad, room)
    assert archive.lz4(b"", 5) == b"" and archive.lz4(b"\x14a\x01\x00", 9) == b"a" * 9
    for bad, room in [(b"", 0), (b"\x14a\x01\x00", 9), (block, 15), (bytes([0x14]) + b"a\x01\x00" + b"\x10b", 10)]:
        with pytest.raises(Reject):
            archive.lz4(bad, room, exact=True)


def test_value_tree_and_digest():
    for big in (False, True):
        raw, table = tree(SIMPLE, big)
        nodes = schema.compile_schema(raw, table, big)
        assert schema.grammar_error(nodes) is None
        body = simple_payload(-5, b"abc", b"\x01\x02\x03", big)
        plain, used = schema.parse_value(nodes, body, big)
        packed, _ = schema.parse_value(nodes, body, big, pack=True)
        assert used == len(body)
        assert schema.value_digest(plain) == schema.value_digest(packed)
        assert schema.as_int(schema.find_path(plain, "number")) == -5 and schema.as_uint(schema.find_path(plain, "number")) is None
        assert schema.find_path(plain, "/label").text == b"abc" and schema.find_path(plain, "label.x") is None
        assert len(schema.get_array(schema.find_path(plain, "bytes")).items) == 3
        assert [r["path"] for r in schema.flatten(packed)] == ["", "number", "label", "bytes"]
        for n in range(len(body)):
            with pytest.raises(Reject):
                schema.parse_value(nodes, body[:n], big)


def test_digest_known_values():
    v = schema.Value("int", b"value", b"SInt64", -7)
    base = schema.value_digest(v)
    assert base == schema.value_digest(schema.Value("int", b"value", b"SInt64", -7)) and len(base) == 64
    seen = {base}
    for other in (
        schema.Value("int", b"value", b"SInt64", (1 << 64) - 7, True), schema.Value("float", b"value", b"double", 0.0), schema.Value("float", b"value", b"double", -0.0),
        schema.Value("string", b"value", b"string", text=b"x"), schema.Value("none", b"value", b"x"), schema.Value("struct", b"value", b"x", items=[v]),
    ):
        seen.add(schema.value_digest(other))
    assert len(seen) == 7
    assert schema.value_digest(v, b"another.v1") != base


def test_grammar_refuses():
    def first_bad(nodes):
        raw, table = tree(nodes)
        return schema.grammar_error(schema.compile_schema(raw, table, False))

    ok = [("T", "Base", 0, 0, -1, 0), ("int", "a", 1, 0, 4, 0)]
    assert first_bad(ok) is None
    assert first_bad([ok[0], ("int", "a", 1, 0, 8, 0)]) == 1
    assert first_bad([ok[0], ("opaque", "a", 1, 0, 4, 0)]) == 1
    assert first_bad([ok[0], ("string", "a", 1, 0, -1, 0), ("Array", "Array", 2, 1, -1, 0), ("int", "size", 3, 0, 4, 0), ("UInt8", "data", 3, 0, 1, 0)]) is not None
    assert first_bad([ok[0], ("vector", "a", 1, 0, -1, 0), ("Array", "Array", 2, 1, -1, 0), ("int", "count", 3, 0, 4, 0), ("int", "data", 3, 0, 4, 0)]) is not None
    with pytest.raises(Reject):
        raw, table = tree([ok[0], ("int", "a", 2, 0, 4, 0)])
        schema.compile_schema(raw, table, False)


def test_string_table():
    assert len(schema.COMMON_TABLE) == 1170
    assert schema.name_at(schema.COMMON_BIT, b"") == b"AABB" and schema.name_at(schema.COMMON_BIT | 1, b"") is None
    assert schema.name_at(schema.COMMON_BIT | 1169, b"") == b"" and schema.name_at(schema.COMMON_BIT | 1170, b"") is None
    assert schema.name_at(3, b"ab\0cd\0") == b"cd" and schema.name_at(4, b"ab\0cd\0") is None and schema.name_at(3, b"ab\0cd") is None


def entry_of(nodes, class_id=1, engine=b"2021.3.35f1"):
    f = container.decode(serialized([dict(class_id=class_id, nodes=nodes)], [], b""))
    t = f.types[0]
    return registry.key_of(t, 22, engine) | {"nodes": t["nodes"], "strings": t["strings"], "dependencies": [], "class_name": b"", "name_space": b"", "assembly": b""}


def test_registry_file():
    entries = [entry_of(SIMPLE, k) for k in (7, 3, 5)]
    data = registry.serialize(entries)
    assert data == registry.serialize(entries[::-1])
    back = registry.deserialize(data)
    assert [e["class_id"] for e in back] == [3, 5, 7] and registry.serialize(back) == data
    for at in (0, 8, 16, 24, 40, 70, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 0xFF
        with pytest.raises(Reject):
            registry.deserialize(bytes(bad))
    with pytest.raises(Reject):
        registry.deserialize(data + b"\0")
    with pytest.raises(Reject):
        registry.serialize([entries[0], entries[0]])
    big = container.decode(serialized([dict(class_id=3, nodes=SIMPLE)], [], b"", big=True)).types[0]
    assert registry.little_endian_nodes(big["nodes"], True) == entries[1]["nodes"]


def test_known_profiles():
    assert schema.known_profile("2021.3.35f1", 21, bytes.fromhex("c60098aca6a28b50aa0580db11bf018c"), "0" * 64) == "invalid"
    assert schema.known_profile("2021.3.35f1", 22, bytes(16), "0" * 64) == "unknown"


def test_context():
    nodes = [("T", "Base", 0, 0, -1, 0), ("int", "a", 1, 0, 4, 0), ("R", "references", 1, 4, -1, 0), ("int", "v", 2, 0, 4, 0)]
    c = schema.compile_schema(*tree(nodes), False)
    assert schema.context(c, False)["traversal_end"] == 4
    assert schema.context(c, True) == {"kind": "selected-reference-payload", "traversal_end": 2, "registry": 2, "registry_end": 4, "registry_omitted": True}
    for k, status in ((1, "unsupported-registry-position"), (3, "unsupported-registry-position")):
        bad = [list(n) for n in nodes]
        bad[k][3] = 4
        with pytest.raises(Reject) as e:
            schema.context(schema.compile_schema(*tree(bad), False), True)
        assert e.value.status == status


def _named(shape):
    return [(t or "Authored", f or "authored", level, flags, size, meta) for t, f, level, flags, size, meta in shape]


def _string(out, text):
    return out.put("i", len(text)).raw(text).align(4)


def ordinary_file():
    text = bytes(_string(_string(Out(), b"name"), b"script!").data)
    mono = bytes(_string(Out().put("iqB", 1, 2, 1).align(4).put("iq", 0, -4), b"n").put("i", 42).data)
    pptr = bytes(_string(Out().put("iqB", 1, 2, 1).align(4).put("iq", 0, -4), b"n").put("iq", 3, 99).data)
    types = [dict(class_id=49, nodes=_named(objects.TEXT_ASSET)), dict(class_id=114, script_index=0, nodes=_named(objects.SCRIPTED_INT)), dict(class_id=114, script_index=1, nodes=_named(objects.SCRIPTED_TEXT))]
    offsets, payload = [], b""
    for body in (text, mono, pptr):
        offsets.append((len(payload), len(body)))
        payload += body.ljust(-(-len(body) // 16) * 16, b"\0")
    return serialized(types, [(k + 1, at, n, k) for k, (at, n) in enumerate(offsets)], payload)


def values_of(data, k):
    f = container.decode(data)
    o = f.objects[k]
    t = f.types[o["type_ordinal"]]
    nodes = schema.compile_schema(t["nodes"], t["strings"], False)
    return objects.decode_ordinary(data, f.header["data_offset"] + o["rel_offset"], o["byte_size"], t, nodes)


def test_ordinary_objects():
    data = ordinary_file()
    text, mono, pptr = (values_of(data, k) for k in range(3))
    assert [len(v) for v in (text, mono, pptr)] == [3, 10, 12]
    assert [v["bytes"] for v in text[1:]] == [b"name", b"script!"] and text[0]["child_count"] == 2
    assert [v["bits"] for v in mono if v["bits"] is not None] == [1, 2, 1, 0, -4, 42]
    assert mono[0]["subtree_end"] == 10 and mono[1]["first_child"] == 2 and mono[1]["next_sibling"] == 4 and mono[9]["next_sibling"] is None
    assert [v["bits"] for v in pptr[-2:]] == [3, 99] and pptr[-1]["parent"] == 9


def managed_file(rows=((-2, "", "", "", b""),), first=-2, second=-2, items=(), refs=True):
    host = _named([*objects.HOST, *objects.REGISTRY])
    alpha, beta = _named([*objects.PAYLOAD_TEXT, *objects.REGISTRY]), _named([*objects.PAYLOAD_FLOAT, *objects.REGISTRY])
    out = Out().put("iqB", 0, 0, 1).align(4).put("iq", 0, 5)
    _string(_string(out, b"host"), b"tag").put("qqi", first, second, len(items))
    out.put(f"{len(items)}q", *items).put("ii", 2, len(rows))
    for rid, cls, ns, asm, payload in rows:
        out.put("q", rid)
        for name in (cls, ns, asm):
            _string(out, name.encode())
        out.raw(payload)
    body = bytes(out.data)
    types = [dict(class_id=114, script_index=0, nodes=host)]
    ref_rows = [dict(class_id=-1, script_index=0, nodes=alpha, reference=("Alpha", "N", "A")), dict(class_id=-1, script_index=1, nodes=beta, reference=("Beta", "N", "A"))] if refs else []
    return serialized(types, [(1001, 0, len(body), 0)], body, refs=ref_rows)


def alpha(marker, label, rid):
    return bytes(_string(Out().put("i", marker), label).put("q", rid).data)


def beta(marker, amount, rid):
    return bytes(Out().put("ifq", marker, amount, rid).data)


def managed(data):
    f = container.decode(data)
    compiled = lambda t: schema.compile_schema(t["nodes"], t["strings"], False)
    o = f.objects[0]
    return objects.decode_managed(data, f.header["data_offset"], o["byte_size"], f.types[0], compiled(f.types[0]), [(r, compiled(r)) for r in f.ref_types])


def test_managed_objects():
    null = managed(managed_file())
    assert (len(null["values"]), len(null["rows"]), len(null["slots"])) == (16, 1, 2) and null["rows"][0]["kind"] == "null"
    single = managed(managed_file([(-2, "", "", "", b""), (1, "Alpha", "N", "A", alpha(7, b"x", -2))], 1, -2))
    assert (len(single["values"]), len(single["rows"]), len(single["slots"])) == (23, 2, 3)
    shared = managed(managed_file([(-2, "", "", "", b""), (1, "Alpha", "N", "A", alpha(7, b"x", -2))], 1, 1, (1, 1, 1)))
    assert (len(shared["values"]), len(shared["slots"]), shared["array_elements"]) == (26, 6, 3)
    two = managed(managed_file([(-2, "", "", "", b""), (1, "Alpha", "N", "A", alpha(7, b"x", 2)), (2, "Beta", "N", "A", beta(8, 1.5, 1))], 1, 2, (1, 2)))
    assert (len(two["values"]), len(two["rows"]), len(two["slots"])) == (32, 3, 6)
    for rows, status in (
        ([(3, "", "", "", b"")], "unsupported-null-row"), ([(1, "Gamma", "N", "A", b"")], "reference-type-missing"),
        ([(1, "Terminus", "UnityEngine.DMAT", "FAKE_ASM", b"")], "unsupported-terminator"), ([(1, "Alpha", "N", "A", alpha(1, b"", 1) + b"1234")], "trailing-object-bytes"),
    ):
        with pytest.raises(Reject) as e:
            managed(managed_file(rows))
        assert e.value.status == status


def settings_payload(big=False, version=b"2021.3.35f1"):
    out = Out(big)
    for texts in ((b"Assets/a",), (b"p",), (), (b"tag",)):
        out.put("i", len(texts))
        for t in texts:
            out.put("i", len(t)).raw(t).align(4)
    out.raw(bytes(range(16)))
    for k in range(15):
        out.put("B", k % 2)
    out.align(4).put("i", len(version)).raw(version).align(4).put("i2i", 2, 2, 17)
    return bytes(out.data)


@pytest.mark.parametrize("big", [False, True])
def test_build_settings(big):
    def of(payload, n=1, type_hash=build_settings.TYPE_HASH, cls=141):
        data = serialized([dict(class_id=cls, type_hash=type_hash)], [(k, 0, len(payload), 0) for k in range(n)], payload, big=big)
        return build_settings.decode(container.decode(data), data)

    good = settings_payload(big)
    found = of(good)
    assert (found["scene_count"], found["preloaded_plugin_count"], found["enabled_vr_device_count"], found["build_tag_count"]) == (1, 1, 0, 1)
    assert found["graphics_apis"] == [2, 17] and found["is_no_watermark_build"] and not found["has_pro_version"]

    def status(*a, **k):
        with pytest.raises(Reject) as e:
            of(*a, **k)
        return e.value.status

    assert status(good, n=2) == "build-settings-duplicate" and status(good, cls=1) == "build-settings-missing"
    assert status(good, type_hash=bytes(16)) == "type-identity-unsupported" and status(good + bytes(4)) == "object-bytes-not-exhausted"
    assert status(settings_payload(big, b"2021.3.35f2")) == "version-mismatch" and status(b"") == "object-range-invalid"
    for n in range(1, len(good)):
        with pytest.raises(Reject):
            of(good[:n])


@pytest.mark.parametrize("version,width", [(16, 24), (17, 24), (18, 32), (21, 32), (22, 32)])
@pytest.mark.parametrize("reference", [False, True])
def test_legacy_types(version, width, reference):
    raw, table = tree(SIMPLE)
    nodes = b"".join(raw[k:k + width] for k in range(0, len(raw), 32))
    out = Out().put("iB", 114 if version >= 17 else -5, 1)
    if version >= 17:
        out.put("H", 3)
    out.raw(b"s" * 16).raw(b"h" * 16).put("II", len(SIMPLE), len(table)).raw(nodes).raw(table)
    if version >= 21:
        out.raw(b"C\0N\0A\0") if reference else out.put("I2i", 2, 7, -7)
    data = bytes(out.data)
    row = read_type(Cursor(data, big=False), version, True, reference)
    assert row["stripped"] and row["script_hash"] == b"s" * 16 and row["script_index"] == (3 if version >= 17 else 0xFFFF)
    assert row["dependencies"] == ([7, -7] if version >= 21 and not reference else []) and (version < 21 or not reference or row["assembly"] == b"A")
    assert [n.level for n in schema.compile_schema(row["nodes"], row["strings"], False)] == [n[2] for n in SIMPLE]
    for n in range(len(data)):
        with pytest.raises(Reject):
            read_type(Cursor(data[:n], big=False), version, True, reference)
