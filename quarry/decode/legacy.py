"""Type records as older format versions write them, one at a time."""

from __future__ import annotations

import struct

from .container import MAX_DEPENDENCIES, MAX_NODES, NODE_BYTES, SCRIPTED_CLASS
from .cursor import Cursor, Reject
from .schema import compile_schema, grammar_error

NO_SCRIPT = 0xFFFF


def _wide_nodes(raw: bytes, count: int, order: str) -> bytes:
    """Node records of 24 bytes, without the last eight, as records of 32."""
    width = struct.calcsize(order + "HBBIIiII")
    return b"".join(raw[k * width: (k + 1) * width] + bytes(NODE_BYTES - width) for k in range(count))


def read_type(c: Cursor, version: int, has_tree: bool, reference: bool = False) -> dict:
    """The type record at the cursor, under the rules of a format version.

    From 16 on a record tells whether it is stripped, from 17 on it has a script index, from
    18 on nodes have 32 bytes, and from 21 on dependencies or, for a reference type, names
    follow the tree.
    """
    c.field = "type"
    row = {"class_id": c.i32(), "stripped": False, "script_index": NO_SCRIPT, "script_hash": None, "nodes": None, "strings": None, "dependencies": []}
    if version >= 16:
        flag = c.u8()
        if flag > 1:
            raise c.fail("boolean-invalid", c.at - 1)
        row["stripped"] = bool(flag)
    if version >= 17:
        row["script_index"] = c.u16()
        hashed = row["class_id"] == SCRIPTED_CLASS
    else:
        hashed = row["class_id"] < 0
    if hashed or reference and row["script_index"] != NO_SCRIPT:
        row["script_hash"] = c.take(16)
    row["type_hash"] = c.take(16)
    if not has_tree:
        return row
    nodes, strings = c.u32(), c.u32()
    width = NODE_BYTES if version >= 18 else 24
    if not 0 < nodes <= min(MAX_NODES, c.left // width):
        raise c.fail("count-invalid")
    raw = c.take(nodes * width)
    row["nodes"] = raw if width == NODE_BYTES else _wide_nodes(raw, nodes, c.order)
    row["strings"] = c.take(strings)
    if version >= 21 and reference:
        row |= {name: c.text() for name in ("class_name", "name_space", "assembly")}
    elif version >= 21:
        n = c.u32()
        if n > min(MAX_DEPENDENCIES, c.left // 4):
            raise c.fail("count-invalid")
        row["dependencies"] = [c.i32() for _ in range(n)]
    bad = grammar_error(compile_schema(row["nodes"], row["strings"], c.order == ">"))
    if bad is not None:
        raise Reject("invalid-schema", "grammar", bad)
    return row
