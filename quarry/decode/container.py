"""Serialized files of format 22: header, prefix, directory and metadata tail.

Physical tables keep what the bytes say: duplicate ids, overlapping ranges, raw flags and
full unsigned offsets.  The stricter semantic rules are in ``semantic_errors`` and in the
operators over the tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .cursor import Cursor, Reject

# Fixed values of the format.
FORMAT = 22
HEADER_BYTES = 48
NODE_BYTES = 32
ENGINE = b"2021.3.35f1"
OLDER_ENGINE = b"2021.3.29f1"
SCRIPTED_CLASS = 114

#: Most rows, nodes and bytes that a file may declare.
MAX_TYPES, MAX_OBJECTS, MAX_NODES, MAX_DEPENDENCIES = 65_536, 1_048_576, 1_048_576, 1_048_576
MAX_STRING_BYTES, MAX_METADATA_BYTES = 64 << 20, 256 << 20


def header(data: bytes, size: int | None = None) -> dict:
    """The 48-byte header.  ``data`` may be a prefix of a file of ``size`` bytes."""
    size = len(data) if size is None else size
    if size < HEADER_BYTES:
        raise Reject("malformed-layout", "header", None, size)
    if len(data) < HEADER_BYTES:
        raise Reject("incomplete-mapping", "header", None, len(data))
    c = Cursor(data, 8, HEADER_BYTES)
    if c.u32() != FORMAT:
        raise Reject("unsupported-version", "format", None, 8)
    if data[40] > 1:
        raise Reject("unsupported-endian", "endian", None, 40)
    c.at = 16
    metadata_size, file_size, data_offset = c.u64(), c.u64(), c.u64()
    if file_size != size:
        raise Reject("malformed-layout", "file_size", None, 24)
    if data_offset > file_size:
        raise Reject("malformed-layout", "data_offset", None, 32)
    if HEADER_BYTES + metadata_size > min(data_offset, (1 << 64) - 1):
        raise Reject("malformed-layout", "metadata_size", None, 16)
    return {"metadata_size": metadata_size, "file_size": file_size, "data_offset": data_offset, "endian": data[40]}


def prefix(data: bytes, size: int | None = None) -> tuple[dict, Cursor]:
    """Header and the start of the metadata: version, target and tree flag."""
    h = header(data, size)
    c = Cursor(data, HEADER_BYTES, HEADER_BYTES + h["metadata_size"], bool(h["endian"]), "malformed-metadata")
    if c.end > len(data):
        c.end, c.short = len(data), "incomplete-mapping"
    c.field = "version"
    stop = data.find(b"\0", c.at, c.end)
    if stop < 0:
        raise Reject(c.short, "version", None, c.end)
    h["version"] = c.text()
    c.field = "target"
    h["target"] = c.u32()
    c.field = "tree"
    h["tree_raw"] = c.u8()
    return h, c


@dataclass
class File:
    header: dict
    types: list[dict] = field(default_factory=list)
    objects: list[dict] = field(default_factory=list)
    scripts: list[dict] = field(default_factory=list)
    externals: list[dict] = field(default_factory=list)
    ref_types: list[dict] = field(default_factory=list)
    user_information: bytes = b""


def carries_script_hash(class_id: int, script_index: int) -> bool | None:
    """Whether a type row holds a script hash; None for the one shape that is refused."""
    negative = script_index < 0
    if class_id == -1 and negative:
        return None
    return class_id == SCRIPTED_CLASS or not negative


class _Totals:
    def __init__(self) -> None:
        self.used = dict.fromkeys(("nodes", "strings", "dependencies"), 0)

    def add(self, c: Cursor, what: str, n: int, most: int, offset: int) -> None:
        if n > most - self.used[what]:
            raise c.fail(f"limit-exceeded-{what}", offset)
        self.used[what] += n


def _type_row(c: Cursor, ordinal: int, totals: _Totals, tree: bool, reference: bool) -> dict:
    c.field, c.row, start = "reference-type" if reference else "type", ordinal, c.at
    row = {"ordinal": ordinal, "class_id": c.i32(), "stripped_raw": c.u8()}
    script_index = c.u16()
    row["script_index"] = script_index - (script_index >> 15 << 16)
    hashed = carries_script_hash(row["class_id"], row["script_index"])
    if hashed is None:
        raise c.fail("unsupported-type-shape", start)
    row["script_hash"] = c.take(16) if hashed else None
    row["type_hash"] = c.take(16)
    row |= {"has_tree": tree, "node_count": 0, "string_bytes": 0, "nodes": None, "strings": None}
    if not reference:
        row["dependencies"] = []
    if tree:
        c.field, at = "tree", c.at
        n = row["node_count"] = c.u32()
        if not n:
            raise c.fail("unsupported-empty-tree", at)
        totals.add(c, "nodes", n, MAX_NODES, at)
        at = c.at
        s = row["string_bytes"] = c.u32()
        totals.add(c, "strings", s, MAX_STRING_BYTES, at)
        row["nodes"], row["strings"] = c.take(NODE_BYTES * n), c.take(s)
        if not reference:
            c.field, at = "dependencies", c.at
            d = c.count()
            totals.add(c, "dependencies", d, MAX_DEPENDENCIES, at)
            words = Cursor(c.take(4 * d), big=c.order == ">")
            row["dependencies"] = [words.i32() for _ in range(d)]
    if reference:
        row |= {"class_name": None, "name_space": None, "assembly": None}
        if tree:
            for name in ("class_name", "name_space", "assembly"):
                c.field = name
                row[name] = c.text()
    row |= {"row_offset": start, "row_bytes": c.at - start}
    return row


def directory(data: bytes, engines: tuple[bytes, ...] = (ENGINE, OLDER_ENGINE)) -> tuple[File, Cursor]:
    """Types and objects, in the order of the bytes; the cursor stands where the tail begins."""
    h, c = prefix(data)
    if h["version"] not in engines:
        at = next((i for i, (x, y) in enumerate(zip(h["version"], engines[0])) if x != y), min(len(h["version"]), len(engines[0])))
        raise Reject("unsupported-engine-version", "version", None, HEADER_BYTES + at)
    if h["tree_raw"] > 1:
        raise Reject("unsupported-tree-flag", "tree", None, c.at - 1)
    if h["metadata_size"] > MAX_METADATA_BYTES:
        raise Reject("limit-exceeded-metadata", "metadata_size", None, 16)
    out, totals = File(h), _Totals()
    c.field, at = "type-count", c.at
    n = c.count()
    if n > MAX_TYPES:
        raise c.fail("limit-exceeded-types", at)
    out.types = [_type_row(c, k, totals, bool(h["tree_raw"]), False) for k in range(n)]
    c.field, c.row, at = "object-count", None, c.at
    n = c.count()
    if n > MAX_OBJECTS:
        raise c.fail("limit-exceeded-objects", at)
    if n:  # padding counts from the start of the metadata, and only objects have it
        c.field = "object-padding"
        c.align(4, HEADER_BYTES)
    room = h["file_size"] - h["data_offset"]
    for k in range(n):
        c.field, c.row, at = "object", k, c.at
        row = {"ordinal": k, "path_id": c.i64(), "rel_offset": c.u64(), "byte_size": c.u32(), "type_ordinal": c.u32()}
        if row["rel_offset"] > room:
            raise Reject("malformed-metadata", "object-range", k, at + 8)
        if row["byte_size"] > room - row["rel_offset"]:
            raise Reject("malformed-metadata", "object-range", k, at + 16)
        if row["type_ordinal"] >= len(out.types):
            raise Reject("malformed-metadata", "object-type", k, at + 20)
        out.objects.append(row | {"row_offset": at})
    return out, c


def decode(data: bytes, engines: tuple[bytes, ...] = (ENGINE, OLDER_ENGINE)) -> File:
    """All metadata of a file, which must be used up to its last byte."""
    out, c = directory(data, engines)
    totals = _Totals()
    c.field, c.row = "script-count", None
    for k in range(c.count()):
        c.field, c.row, at = "script", k, c.at
        file_index = c.i32()
        c.align(4, HEADER_BYTES)
        out.scripts.append({"ordinal": k, "file_index": file_index, "path_id": c.i64(), "row_offset": at})
    c.field, c.row = "external-count", None
    for k in range(c.count()):
        c.field, c.row, at = "external", k, c.at
        out.externals.append({"ordinal": k, "virtual_path": c.text(), "guid": c.take(16), "type": c.i32(), "path_name": c.text(), "row_offset": at})
    c.field, c.row = "reference-type-count", None
    for k in range(c.count()):
        out.ref_types.append(_type_row(c, k, totals, bool(out.header["tree_raw"]), True))
    c.field, c.row = "user-information", None
    out.user_information = c.text()
    if c.left:
        raise Reject("malformed-metadata", "exhaustion", None, c.at)
    return out


def semantic_errors(file: File) -> list[tuple[str, int]]:
    """Rows that the physical tables admit and the semantic view doesn't, as (rule, ordinal)."""
    out = [("signed-offset", o["ordinal"]) for o in file.objects if o["rel_offset"] >= 1 << 63]
    for rows, kind in ((file.types, "type"), (file.ref_types, "reference-type")):
        out += [(f"{kind}-stripped", r["ordinal"]) for r in rows if r["stripped_raw"] > 1]
    return out


def probe(head: bytes, size: int) -> tuple[str, int | None]:
    """What a file is, from its first 96 bytes: kind and format version."""
    if head.startswith(b"UnityFS\0"):
        return "archive", None
    if head.startswith((b"UnityRaw\0", b"UnityWeb\0", b"UnityArchive\0")):
        return "unsupported-archive", None
    if len(head) < 20:
        return "unrelated", None
    version = int.from_bytes(head[8:12], "big")
    if not 0 < version <= 100 or version != FORMAT and (head[16] > 1 or any(head[17:20])):
        return "unrelated", None
    try:
        header(head, size)
    except Reject:
        return "unsupported-serialized-file", version
    return "serialized-file", version
