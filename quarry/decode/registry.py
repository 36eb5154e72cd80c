"""The canonical file of a schema registry: key and schema of every entry, in key order."""

from __future__ import annotations

import hashlib
import struct

from .container import NODE_BYTES, carries_script_hash
from .cursor import Cursor, Reject
from .schema import compile_schema, grammar_error

# Fixed values of the format.
MAGIC, FORMAT_VERSION, HEADER_BYTES = b"DXTTSR01", 1, 64
SCRIPT_HASH, REFERENCE, STRIPPED = 1, 2, 4

#: The fields of a key, in the order that entries are sorted by.
KEY = ("file_version", "engine", "class_id", "type_id", "script_index", "has_script_hash", "is_stripped", "is_ref", "script_hash", "type_hash")
MAX_FILE, MAX_ENTRIES, MAX_NODES = 512 << 20, 65_536, 1_048_576
ZERO = bytes(16)


def key_of(row: dict, file_version: int, engine: bytes, reference: bool = False) -> dict:
    """The registry key of a decoded type row."""
    if not engine or row["stripped_raw"] > 1:
        raise Reject("invalid-argument", "key")
    hashed = carries_script_hash(row["class_id"], row["script_index"])
    if hashed is None:
        raise Reject("invalid-schema", "key")
    return {
        "file_version": file_version, "engine": engine, "class_id": row["class_id"], "type_id": row["class_id"],
        "script_index": row["script_index"] & 0xFFFF, "has_script_hash": hashed, "is_stripped": bool(row["stripped_raw"]),
        "is_ref": reference, "script_hash": row["script_hash"] if hashed else ZERO, "type_hash": row["type_hash"]}


def sort_key(entry: dict) -> tuple:
    return tuple(entry[k] for k in KEY)


def schema_bytes(entry: dict) -> bytes:
    """What two schemas of one key must agree in."""
    names = [entry.get(k) or b"" for k in ("class_name", "name_space", "assembly")]
    deps = entry.get("dependencies") or []
    return b"".join((
        struct.pack("<IIIIIII", bool(entry["is_stripped"]), len(entry["nodes"]) // NODE_BYTES, len(entry["strings"]), len(deps), *map(len, names)),
        entry["nodes"], entry["strings"], struct.pack(f"<{len(deps)}i", *deps), *names))


def little_endian_nodes(nodes: bytes, big: bool) -> bytes:
    """Node records as the registry stores them, whatever order the file has."""
    if not big:
        return nodes
    rows = (struct.unpack_from(">HBBIIiII8s", nodes, at) for at in range(0, len(nodes), NODE_BYTES))
    return b"".join(struct.pack("<HBBIIiII", *r[:8]) + r[8][::-1] for r in rows)


def _check(entry: dict) -> None:
    nodes = compile_schema(entry["nodes"], entry["strings"], False)
    if grammar_error(nodes) is not None:
        raise Reject("invalid-schema", "grammar", grammar_error(nodes))


def serialize(entries: list[dict]) -> bytes:
    """The file of a registry; the same entries give the same bytes in any order."""
    if len(entries) > MAX_ENTRIES:
        raise Reject("limit-exceeded", "entries")
    records, last = [], None
    for entry in sorted(entries, key=sort_key):
        _check(entry)
        if sort_key(entry) == last:
            raise Reject("key-conflict", "entries")
        last = sort_key(entry)
        flags = entry["has_script_hash"] * SCRIPT_HASH | entry["is_ref"] * REFERENCE | entry["is_stripped"] * STRIPPED
        body = b"".join((
            struct.pack("<II", entry["file_version"], len(entry["engine"])), entry["engine"],
            struct.pack("<iiHH", entry["class_id"], entry["type_id"], entry["script_index"], flags),
            entry["script_hash"], entry["type_hash"], schema_bytes(entry)))
        records.append(struct.pack("<Q", len(body) + 8) + body)
    payload = b"".join(records)
    head = MAGIC + struct.pack("<HHIIIQ", FORMAT_VERSION, HEADER_BYTES, 0, len(entries), 0, HEADER_BYTES + len(payload))
    return head + hashlib.sha256(payload).digest() + payload


def deserialize(data: bytes) -> list[dict]:
    """The entries of a registry file; refuses anything that ``serialize`` wouldn't write."""
    if len(data) > MAX_FILE:
        raise Reject("limit-exceeded", "file")
    c = Cursor(data, big=False)
    c.field = "header"
    if c.take(8) != MAGIC:
        raise Reject("invalid-format", "magic", None, 0)
    version, header, flags, n, reserved, total = struct.unpack("<HHIIIQ", c.take(24))
    if version != FORMAT_VERSION:
        raise Reject("unsupported-version", "header", None, 8)
    if header != HEADER_BYTES or flags or reserved or total != len(data) or n > MAX_ENTRIES:
        raise Reject("invalid-format", "header", None, 10)
    if c.take(32) != hashlib.sha256(data[HEADER_BYTES:]).digest():
        raise Reject("checksum-mismatch", "payload", None, 32)
    out, nodes_seen = [], 0
    for k in range(n):
        c.field, c.row, start = "record", k, c.at
        size = c.u64()
        entry = {"file_version": c.u32(), "engine": c.take(c.u32()), "class_id": c.i32(), "type_id": c.i32(), "script_index": c.u16()}
        flags = c.u16()
        if flags & ~(SCRIPT_HASH | REFERENCE | STRIPPED) or not entry["engine"] or b"\0" in entry["engine"]:
            raise c.fail("invalid-format", start)
        entry |= {"has_script_hash": bool(flags & SCRIPT_HASH), "is_stripped": bool(flags & STRIPPED), "is_ref": bool(flags & REFERENCE), "script_hash": c.take(16), "type_hash": c.take(16)}
        stripped, count, strings, deps, *names = (c.u32() for _ in range(7))
        nodes_seen += count
        if stripped != entry["is_stripped"] or nodes_seen > MAX_NODES or not entry["has_script_hash"] and entry["script_hash"] != ZERO:
            raise c.fail("invalid-format", start)
        entry |= {"nodes": c.take(count * NODE_BYTES), "strings": c.take(strings)}
        words = Cursor(c.take(4 * deps), big=False)
        entry["dependencies"] = [words.i32() for _ in range(deps)]
        for name, width in zip(("class_name", "name_space", "assembly"), names):
            entry[name] = c.take(width)
        if c.at - start != size:
            raise c.fail("invalid-format", start)
        _check(entry)
        if out and sort_key(out[-1]) >= sort_key(entry):
            raise c.fail("not-canonical", start)
        out.append(entry)
    if c.left:
        raise c.fail("trailing-bytes")
    return out
