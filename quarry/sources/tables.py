"""From file contents to typed tables, one Arrow batch function per granularity.

Every source row has ``path`` and ``member`` (0 for a loose file).  A source that a decoder
refuses gives no data rows, and one row of ``diagnostics``.  Ordinals carry the order of the
bytes, as a DataFrame has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.decode import archive, build_settings, container, objects, registry, schema
from quarry.decode.cursor import Reject

U64 = "decimal(20,0)"
KEYS = "path string, member int"
SCHEMAS = {
    "archives": f"path string, version long, generation binary, engine binary, total_size {U64}, info_csize long, info_usize long, flags long",
    "archive_blocks": "path string, ordinal int, usize long, csize long, flags int",
    "members": f"path string, ordinal int, offset {U64}, size {U64}, flags long, name binary, kind string, data binary",
    "headers": f"{KEYS}, metadata_size {U64}, file_size {U64}, data_offset {U64}, endian int, version binary, target long, tree_raw int, user_information binary",
    "types": f"{KEYS}, ordinal int, class_id int, stripped_raw int, script_index int, script_hash binary, type_hash binary, has_tree boolean, node_count long, string_bytes long, dependencies array<int>, row_offset long, row_bytes long",
    "objects": f"{KEYS}, ordinal int, path_id long, rel_offset {U64}, byte_size long, type_ordinal int, row_offset long, data_offset {U64}",
    "scripts": f"{KEYS}, ordinal int, file_index int, path_id long, row_offset long",
    "externals": f"{KEYS}, ordinal int, virtual_path binary, guid binary, type int, path_name binary, row_offset long",
    "ref_types": f"{KEYS}, ordinal int, class_id int, stripped_raw int, script_index int, script_hash binary, type_hash binary, has_tree boolean, node_count long, string_bytes long, class_name binary, name_space binary, assembly binary, row_offset long, row_bytes long",
    "type_nodes": f"{KEYS}, row_kind string, type_ordinal int, ordinal int, version int, level int, type_flags int, byte_size int, node_index long, meta_flags long, opaque binary, type_name binary, field_name binary, type_offset long, name_offset long",
    "shapes": f"{KEYS}, row_kind string, type_ordinal int, class_id int, type_hash binary, engine binary, shape_digest string, grammar_error int, profile string",
    "schema_entries": f"{KEYS}, row_kind string, type_ordinal int, file_version int, engine binary, class_id int, type_id int, script_index int, has_script_hash boolean, is_stripped boolean, is_ref boolean, script_hash binary, type_hash binary, schema binary, nodes binary, strings binary, dependencies array<int>, class_name binary, name_space binary, assembly binary",
    "tree_values": f"{KEYS}, object_ordinal int, path_id long, ordinal int, value_path string, depth int, kind string, type_name string, int_value long, uint_value {U64}, double_value double, bytes_value binary, count long, value_digest string",
    "value_paths": f"{KEYS}, object_ordinal int, path_id long, value_path string, kind string, as_int long, as_uint {U64}, text binary, count long",
    "values": f"{KEYS}, object_ordinal int, path_id long, ordinal int, kind string, node_ordinal int, field_name binary, offset long, size long, bits long, bytes binary, padding int, parent int, first_child int, next_sibling int, child_count int, subtree_end int",
    "managed_values": f"{KEYS}, object_ordinal int, path_id long, ordinal int, kind string, node_ordinal int, field_name binary, registry_row int, ref_type int, offset long, size long, bits long, bytes binary, padding int",
    "registry_rows": f"{KEYS}, object_ordinal int, path_id long, ordinal int, rid long, kind string, class_name binary, name_space binary, assembly binary, match_count int, ref_type int, payload_offset long, payload_size long",
    "rid_slots": f"{KEYS}, object_ordinal int, path_id long, ordinal int, value_ordinal int, registry_row int, rid long",
    "build_settings": f"{KEYS}, status string, path_id long, target long, scene_count int, preloaded_plugin_count int, enabled_vr_device_count int, build_tag_count int, build_guid binary, {', '.join(f'{x} boolean' for x in build_settings.FLAGS)}, version binary, graphics_apis array<int>",
    "diagnostics": f"{KEYS}, stage string, object_ordinal int, status string, field string, row_ordinal long, error_offset long",
}


#: Rows of a batch, and bytes of the sources that they may come from.
TOGETHER_ROWS, TOGETHER_BYTES = 4096, 32 << 20


def _arrow(name: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(SCHEMAS[name]))


def _rows(source: DataFrame, name: str, rows_of: Callable[[dict], Iterator[dict]], columns: tuple[str, ...]) -> DataFrame:
    """Run a decoder over each source row; a refusal counts as no rows."""
    layout = _arrow(name)
    decimals = {f.name for f in layout if pa.types.is_decimal(f.type)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        room = TOGETHER_BYTES
        for batch in batches:
            for source_row in batch.to_pylist():
                try:
                    found = list(rows_of(source_row))
                except Reject:
                    continue
                keys = {k: source_row[k] for k in ("path", "member") if k in source_row}
                for row in found:
                    for k in decimals:
                        row[k] = None if row.get(k) is None else Decimal(row[k])
                    held.append(keys | row)
                room -= sum(len(x) for x in source_row.values() if isinstance(x, (bytes, bytearray))) if found else 0
                if len(held) >= TOGETHER_ROWS or room < 0:
                    yield pa.RecordBatch.from_pylist(held, schema=layout)
                    held, room = [], TOGETHER_BYTES
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=layout)

    return source.select(*columns).mapInArrow(run, SCHEMAS[name])


# Archives

def archives(files: DataFrame) -> DataFrame:
    def rows(f: dict) -> Iterator[dict]:
        yield {k: v for k, v in archive.open_archive(f["content"]).items() if k not in ("blocks", "members", "signature")}

    return _rows(files, "archives", rows, ("path", "content"))


def archive_blocks(files: DataFrame) -> DataFrame:
    return _rows(files, "archive_blocks", lambda f: iter(archive.open_archive(f["content"])["blocks"]), ("path", "content"))


def members(files: DataFrame) -> DataFrame:
    return _rows(files, "members", lambda f: iter(archive.open_archive(f["content"])["members"]), ("path", "content"))


def sources(files: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """``path, member, member_name, is_member, data`` of all serialized files, loose or in
    archives.  ``files`` must have ``kind`` from a probe."""
    loose = files.where("kind = 'serialized-file'").select(
        "path", F.lit(0).alias("member"), F.lit(None).cast("binary").alias("member_name"), F.lit(False).alias("is_member"), F.col("content").alias("data"))
    opened = members(files.where("kind = 'archive'")) if opened is None else opened
    inside = opened.where("kind = 'serialized-file'").select("path", F.col("ordinal").alias("member"), F.col("name").alias("member_name"), F.lit(True).alias("is_member"), "data")
    return loose.unionByName(inside)


def visit(source: DataFrame, visitor: Callable[[dict], bool | Iterator[dict] | None], ddl: str = "done boolean") -> DataFrame:
    """Run a user's function over every source row.  It may give rows of ``ddl``, or nothing;
    False refuses the source, which fails the job."""
    layout = to_arrow_schema(T.StructType.fromDDL(f"{KEYS}, {ddl}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = visitor(row)
                if found is False:
                    raise ValueError(f"visitor-failed: {row['path']}, member {row['member']}")
                keys = {"path": row["path"], "member": row["member"]}
                rows = [keys | r for r in ([] if found is None or found is True else found)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=layout)

    return source.mapInArrow(run, f"{KEYS}, {ddl}")


# Metadata of serialized files; ``source`` has ``path, member, data``

_SOURCE = ("path", "member", "data")


def headers(source: DataFrame) -> DataFrame:
    def rows(s: dict) -> Iterator[dict]:
        f = container.decode(s["data"])
        yield f.header | {"user_information": f.user_information}

    return _rows(source, "headers", rows, _SOURCE)


def types(source: DataFrame) -> DataFrame:
    return _rows(source, "types", lambda s: iter(container.directory(s["data"])[0].types), _SOURCE)


def objects_table(source: DataFrame) -> DataFrame:
    def rows(s: dict) -> Iterator[dict]:
        f, _ = container.directory(s["data"])
        return iter([o | {"data_offset": f.header["data_offset"]} for o in f.objects])

    return _rows(source, "objects", rows, _SOURCE)


def payloads(objects: DataFrame, source: DataFrame) -> DataFrame:
    """The bytes of each object, sliced from its source."""
    start = (F.col("data_offset") + F.col("rel_offset")).cast("int")
    rows = objects.join(source.select("path", "member", "data"), ["path", "member"])
    return rows.select(*objects.columns, F.substring(F.col("data"), start + 1, F.col("byte_size").cast("int")).alias("payload"))


def scripts(source: DataFrame) -> DataFrame:
    return _rows(source, "scripts", lambda s: iter(container.decode(s["data"]).scripts), _SOURCE)


def externals(source: DataFrame) -> DataFrame:
    return _rows(source, "externals", lambda s: iter(container.decode(s["data"]).externals), _SOURCE)


def ref_types(source: DataFrame) -> DataFrame:
    return _rows(source, "ref_types", lambda s: iter(container.decode(s["data"]).ref_types), _SOURCE)


def _all_types(f: container.File) -> Iterator[tuple[str, dict]]:
    yield from (("type", t) for t in f.types)
    yield from (("reference-type", t) for t in f.ref_types)


def type_nodes(source: DataFrame) -> DataFrame:
    """Schema nodes with their names; parents and children are operators over this table."""

    def rows(s: dict) -> Iterator[dict]:
        f = container.decode(s["data"])
        for kind, t in _all_types(f):
            if t["has_tree"]:
                nodes = schema.read_nodes(t["nodes"], bool(f.header["endian"]))
                schema.bind(nodes, t["strings"])
                for k, n in enumerate(nodes):
                    yield {
                        "row_kind": kind, "type_ordinal": t["ordinal"], "ordinal": k, "version": n.version, "level": n.level, "type_flags": n.type_flags,
                        "byte_size": n.byte_size, "node_index": n.index, "meta_flags": n.meta_flags, "opaque": n.opaque, "type_name": n.type_name,
                        "field_name": n.field_name, "type_offset": n.type_offset, "name_offset": n.name_offset}

    return _rows(source, "type_nodes", rows, _SOURCE)


def shapes(source: DataFrame) -> DataFrame:
    """The shape digest of each embedded schema, its first grammar error, and whether it is
    one of the schemas known to be right."""

    def rows(s: dict) -> Iterator[dict]:
        f = container.decode(s["data"])
        for kind, t in _all_types(f):
            if t["has_tree"]:
                nodes = schema.compile_schema(t["nodes"], t["strings"], bool(f.header["endian"]))
                digest = schema.shape_digest(t, nodes, kind != "type")
                yield {
                    "row_kind": kind, "type_ordinal": t["ordinal"], "class_id": t["class_id"], "type_hash": t["type_hash"], "engine": f.header["version"], "shape_digest": digest,
                    "grammar_error": schema.grammar_error(nodes), "profile": schema.known_profile(f.header["version"].decode(), t["class_id"], t["type_hash"], digest)}

    return _rows(source, "shapes", rows, _SOURCE)


def schema_entries(source: DataFrame) -> DataFrame:
    """Registry keys of all types, with the schema where the file embeds it (else null)."""

    def rows(s: dict) -> Iterator[dict]:
        f = container.decode(s["data"])
        for kind, t in _all_types(f):
            entry = registry.key_of(t, container.FORMAT, f.header["version"], kind != "type")
            if t["has_tree"]:
                names = {k: t.get(k) or b"" for k in ("class_name", "name_space", "assembly")}
                entry |= names | {"nodes": registry.little_endian_nodes(t["nodes"], bool(f.header["endian"])), "strings": t["strings"], "dependencies": t.get("dependencies", [])}
                entry["schema"] = registry.schema_bytes(entry)
            yield entry | {"row_kind": kind, "type_ordinal": t["ordinal"]}

    return _rows(source, "schema_entries", rows, _SOURCE)


# Values of objects

def _payload(f: container.File, data: bytes, o: dict) -> tuple[int, int]:
    return f.header["data_offset"] + o["rel_offset"], o["byte_size"]


def _compiled(f: container.File, t: dict) -> list[schema.Node]:
    if not t["has_tree"]:
        raise Reject("schema-missing", "type", t["ordinal"])
    return schema.compile_schema(t["nodes"], t["strings"], bool(f.header["endian"]))


def _each_object(s: dict, decode: Callable) -> Iterator[dict]:
    """Rows of every object that decodes; one that is refused doesn't stop the others."""
    f = container.decode(s["data"])
    kept: dict[int, list[schema.Node]] = {}
    for o in f.objects:
        t = f.types[o["type_ordinal"]]
        try:
            if o["type_ordinal"] not in kept:
                kept[o["type_ordinal"]] = _compiled(f, t)
            for row in decode(f, s["data"], o, t, kept[o["type_ordinal"]]):
                yield row | {"object_ordinal": o["ordinal"], "path_id": o["path_id"]}
        except Reject:
            continue


def _tree_rows(f, data, o, t, nodes) -> list[dict]:
    if schema.grammar_error(nodes) is not None:
        raise Reject("invalid-schema", "grammar", schema.grammar_error(nodes))
    at, size = _payload(f, data, o)
    value, _ = schema.parse_value(nodes, data[at: at + size], bool(f.header["endian"]), pack=True)
    rows = schema.flatten(value)
    rows[0]["value_digest"] = schema.value_digest(value)
    return [{("value_path" if k == "path" else k): v for k, v in r.items()} for r in rows]


def tree_values(source: DataFrame) -> DataFrame:
    """Values of all objects with a schema, in preorder; the first has the object's digest."""
    return _rows(source, "tree_values", lambda s: _each_object(s, _tree_rows), _SOURCE)


def value_paths(source: DataFrame, paths: list[str]) -> DataFrame:
    """For every object with a schema and each path into its value: what is there, as each
    accessor gives it (``as_int``, ``as_uint``, ``text``) and the length of its array if any."""
    def decode(f, data, o, t, nodes) -> list[dict]:
        at, size = _payload(f, data, o)
        value, _ = schema.parse_value(nodes, data[at: at + size], bool(f.header["endian"]), pack=True)
        out = []
        for path in paths:
            found = schema.find_path(value, path)
            array = schema.get_array(found)
            out.append({
                "value_path": path, "kind": found.kind if found else None, "as_int": schema.as_int(found), "as_uint": schema.as_uint(found),
                "text": found.text if found else None, "count": None if array is None else len(array.items if array.packed is None else array.packed)})
        return out

    return _rows(source, "value_paths", lambda s: _each_object(s, decode), _SOURCE)


def values(source: DataFrame) -> DataFrame:
    """Values of objects of the known ordinary shapes, with their byte ranges."""
    def decode(f, data, o, t, nodes):
        return objects.decode_ordinary(data, *_payload(f, data, o), t, nodes, bool(f.header["endian"]))

    return _rows(source, "values", lambda s: _each_object(s, decode), _SOURCE)


def _managed(part: str) -> Callable:
    def decode(f, data, o, t, nodes):
        refs = [(r, _compiled(f, r)) for r in f.ref_types]
        return objects.decode_managed(data, *_payload(f, data, o), t, nodes, refs, bool(f.header["endian"]))[part]

    return lambda s: _each_object(s, decode)


def managed_values(source: DataFrame) -> DataFrame:
    return _rows(source, "managed_values", _managed("values"), _SOURCE)


def registry_rows(source: DataFrame) -> DataFrame:
    return _rows(source, "registry_rows", _managed("rows"), _SOURCE)


def rid_slots(source: DataFrame) -> DataFrame:
    return _rows(source, "rid_slots", _managed("slots"), _SOURCE)


def build_settings_table(source: DataFrame) -> DataFrame:
    """One row per source with the settings, or with the status that says why there are none."""

    def rows(s: dict) -> Iterator[dict]:
        try:
            yield {"status": "ok"} | build_settings.decode(container.decode(s["data"]), s["data"])
        except Reject as refusal:
            yield {"status": refusal.status}

    return _rows(source, "build_settings", rows, _SOURCE)


def diagnostics(source: DataFrame) -> DataFrame:
    """Why sources were refused: the directory, the tail, then schemas, first failure first."""

    def rows(s: dict) -> Iterator[dict]:
        stage = "directory"
        try:
            container.directory(s["data"])
            stage = "tail"
            f = container.decode(s["data"])
            for rule, ordinal in container.semantic_errors(f):
                raise Reject(rule, "semantic", ordinal)
            stage = "schema"
            for _, t in _all_types(f):
                if t["has_tree"]:
                    bad = schema.grammar_error(_compiled(f, t))
                    if bad is not None:
                        raise Reject("invalid-schema", "grammar", bad)
        except Reject as refusal:
            yield {"stage": stage, "status": refusal.status, "field": refusal.field, "row_ordinal": refusal.row, "error_offset": refusal.offset}

    return _rows(source, "diagnostics", rows, _SOURCE)
