"""Typed values of objects whose schema is one of six known shapes, byte for byte.

A schema qualifies only if every node equals its shape's: names (None stands for an authored
name), flags, sizes and an empty opaque tail.  Nothing is guessed from names alone.
"""

from __future__ import annotations

from .container import SCRIPTED_CLASS
from .cursor import Cursor, Reject
from .schema import ALIGN_FLAG, Node, children

# Fixed values: (type name, field name, level, type flags, byte size, meta flags) of each node.
_STRING_PARTS = lambda level, meta, size, flags=1: [
    ("Array", "Array", level, flags, -1, meta), ("int", "size", level + 1, 0, 4, size), ("char", "data", level + 1, 0, 1, size)]
_POINTER = lambda level, meta: [("int", "m_FileID", level, 0, 4, meta), ("SInt64", "m_PathID", level, 0, 8, meta)]
TEXT_ASSET = [
    ("TextAsset", "Base", 0, 0, -1, 0x8000),
    ("string", "m_Name", 1, 0, -1, 0x88001), *_STRING_PARTS(2, 0x84001, 0x80001),
    ("string", "m_Script", 1, 0, -1, 0x4008001), *_STRING_PARTS(2, 0x4004001, 0x4000001)]
SCRIPTED = [
    ("MonoBehaviour", "Base", 0, 0, -1, 0x8000),
    ("PPtr<GameObject>", "m_GameObject", 1, 0, 12, 0x41), *_POINTER(2, 0x41),
    ("UInt8", "m_Enabled", 1, 0, 1, 0x4101),
    ("PPtr<MonoScript>", "m_Script", 1, 0, 12, 0), *_POINTER(2, 0x800001),
    ("string", "m_Name", 1, 0, -1, 0x88001), *_STRING_PARTS(2, 0x84001, 0x80001)]
SCRIPTED_INT = [*SCRIPTED, ("int", None, 1, 0, 4, 0)]
SCRIPTED_TEXT = [*SCRIPTED, ("PPtr<$TextAsset>", None, 1, 0, 12, 0), *_POINTER(2, 0x800001)]
_RID = lambda level: ("SInt64", "rid", level, 0, 8, 0)
_REFERENCE = [("managedReference", None, 1, 2, 8, 0), _RID(2)]
_REGISTRY_NAME = lambda name: [("string", name, 6, 0, -1, 0x208001), *_STRING_PARTS(7, 0x204001, 0x200001)]
REGISTRY = [
    ("ManagedReferencesRegistry", "references", 1, 4, -1, 0x8001), ("int", "version", 2, 0, 4, 1),
    ("vector", "RefIds", 2, 0, -1, 0x8001), ("Array", "Array", 3, 1, -1, 0xC001), ("int", "size", 4, 0, 4, 1),
    ("ReferencedObject", "data", 4, 0, -1, 0x8001), ("SInt64", "rid", 5, 0, 8, 1),
    ("ReferencedManagedType", "type", 5, 0, -1, 0x208001), *_REGISTRY_NAME("class"), *_REGISTRY_NAME("ns"), *_REGISTRY_NAME("asm"),
    ("ReferencedObjectData", "data", 5, 0, 0, 1)]
HOST = [
    *SCRIPTED, ("string", None, 1, 0, -1, 0x8000), *_STRING_PARTS(2, 0x4001, 1), *_REFERENCE, *_REFERENCE,
    ("Object", None, 1, 8, -1, 0), ("Array", "Array", 2, 1, -1, 0), ("int", "size", 3, 0, 4, 0),
    ("managedRefArrayItem", "data", 3, 2, 8, 0), _RID(4)]
_PAYLOAD = [(None, "Base", 0, 0, -1, 0x8000), ("int", None, 1, 0, 4, 0)]
PAYLOAD_TEXT = [*_PAYLOAD, ("string", None, 1, 0, -1, 0x8000), *_STRING_PARTS(2, 0x4001, 1), *_REFERENCE]
PAYLOAD_FLOAT = [*_PAYLOAD, ("float", None, 1, 0, 4, 0), *_REFERENCE]
#: The identity that ends a registry of another version, which is refused here.
TERMINATOR = (b"Terminus", b"UnityEngine.DMAT", b"FAKE_ASM")
NULL_RID, REGISTRY_VERSION, TEXT_CLASS = -2, 2, 49


def has_shape(nodes: list[Node], shape: list[tuple]) -> bool:
    same = lambda want, got: want is None or want.encode() == got
    return len(nodes) == len(shape) and all(
        same(t, n.type_name) and same(f, n.field_name) and (n.level, n.type_flags, n.byte_size, n.meta_flags) == (level, flags, size, meta)
        and n.version == 1 and n.index == k and not any(n.opaque)
        for k, (n, (t, f, level, flags, size, meta)) in enumerate(zip(nodes, shape)))


def ordinary_shape(row: dict, nodes: list[Node]) -> list[tuple]:
    """The shape of an ordinary object's type, or a refusal."""
    plain = not row["stripped_raw"]
    if plain and row["class_id"] == TEXT_CLASS and row["script_index"] < 0 and has_shape(nodes, TEXT_ASSET):
        return TEXT_ASSET
    if plain and row["class_id"] == SCRIPTED_CLASS and row["script_index"] >= 0:
        for shape in (SCRIPTED_INT, SCRIPTED_TEXT):
            if has_shape(nodes, shape):
                return shape
    raise Reject("unsupported-schema", "type", row["ordinal"])


class _Reader:
    """Values in the order of the bytes.  Alignment counts from the start of the file."""

    def __init__(self, data: bytes, start: int, size: int):
        self.c = Cursor(data, start, start + size, big=False, short="truncated-object")
        self.values: list[dict] = []
        self.scope: tuple[int | None, int | None] = (None, None)  # registry row, selected type

    def _done(self, nodes: list[Node], k: int, kind: str, start: int, **more) -> dict:
        value = {"ordinal": len(self.values), "kind": kind, "node_ordinal": k, "field_name": nodes[k].field_name, "registry_row": self.scope[0], "ref_type": self.scope[1], "offset": start, "size": self.c.at - start, "bits": None, "bytes": None, "padding": 0} | more
        self.values.append(value)
        return value

    def scalar(self, nodes: list[Node], k: int, kind: str = "signed-integer") -> dict:
        self.c.field, self.c.row, start = "scalar", k, self.c.at
        width = nodes[k].byte_size
        bits = int.from_bytes(self.c.take(width), "little", signed=kind == "signed-integer")
        padding = len(self.c.align(4)) if nodes[k].meta_flags & ALIGN_FLAG else 0
        return self._done(nodes, k, kind, start, bits=bits, padding=padding)

    def string(self, nodes: list[Node], k: int) -> dict:
        self.c.field, self.c.row, start = "string", k, self.c.at
        n = self.c.i32()
        if n < 0:
            raise self.c.fail("unsupported-string-length", start)
        text = self.c.take(n)
        return self._done(nodes, k, "byte-string", start, bytes=text, padding=len(self.c.align(4)))

    def finish(self) -> None:
        if self.c.left:
            self.c.field, self.c.row = "object-end", None
            raise self.c.fail("trailing-object-bytes")


def decode_ordinary(data: bytes, start: int, size: int, row: dict, nodes: list[Node], big: bool = False) -> list[dict]:
    """The values of a text asset or of a scripted object of a known shape, in preorder with
    links: containers, then integers and strings."""
    if big:
        raise Reject("unsupported-endian", "object")
    ordinary_shape(row, nodes)
    if start % 4:
        raise Reject("unsupported-object-alignment", "object", None, start)
    r = _Reader(data, start, size)

    def walk(k: int, parent: int | None) -> int:
        node, ordinal = nodes[k], len(r.values)
        if node.type_name == b"string":
            value, inner = r.string(nodes, k), []
        elif not node.child_count:
            value, inner = r.scalar(nodes, k, "unsigned-integer" if node.type_name == b"UInt8" else "signed-integer"), []
        else:
            at = r.c.at
            value = r._done(nodes, k, "container", at)
            inner = [walk(child, ordinal) for child in children(nodes, k)]
            value["size"] = r.c.at - at
        for one, other in zip(inner, inner[1:]):
            r.values[one]["next_sibling"] = other
        value |= {"parent": parent, "first_child": inner[0] if inner else None, "child_count": len(inner), "subtree_end": len(r.values)}
        value.setdefault("next_sibling", None)
        return ordinal

    walk(0, None)
    r.finish()
    return r.values


def decode_managed(data: bytes, start: int, size: int, row: dict, nodes: list[Node], ref_types: list[tuple[dict, list[Node]]], big: bool = False) -> dict:
    """A host with managed references: its ``values``, registry ``rows`` and RID ``slots``.

    How slots resolve against rows is a join, which the tables leave to Spark.
    """
    if big:
        raise Reject("unsupported-endian", "object")
    shape = [*HOST, *REGISTRY]
    if row["class_id"] != SCRIPTED_CLASS or row["stripped_raw"] or row["script_index"] < 0 or not has_shape(nodes, shape):
        raise Reject("unsupported-schema", "type", row["ordinal"])
    if start % 4:
        raise Reject("unsupported-object-alignment", "object", None, start)
    by_name: dict[tuple, list[int]] = {}
    for k, (ref, _) in enumerate(ref_types):
        if ref["class_name"] is None:
            raise Reject("identities-unavailable", "reference-type", k)
        by_name.setdefault((ref["class_name"], ref["name_space"], ref["assembly"]), []).append(k)
    r = _Reader(data, start, size)
    slots: list[dict] = []
    rows: list[dict] = []

    def slot(of: list[Node], k: int) -> None:
        value = r.scalar(of, k)
        slots.append({"ordinal": len(slots), "value_ordinal": value["ordinal"], "registry_row": r.scope[0], "rid": value["bits"]})

    def counted(k: int, what: str) -> int:
        value = r.scalar(nodes, k)
        if value["bits"] < 0:
            raise Reject("unsupported-count", what, k, value["offset"])
        return value["bits"]

    for k in (2, 3):
        r.scalar(nodes, k)
    r.scalar(nodes, 4, "unsigned-integer")
    for k in (6, 7):
        r.scalar(nodes, k)
    r.string(nodes, 8)
    r.string(nodes, 12)
    slot(nodes, 17)
    slot(nodes, 19)
    elements = counted(22, "array-count")
    for _ in range(elements):
        slot(nodes, 24)
    version = r.scalar(nodes, 26)
    if version["bits"] != REGISTRY_VERSION:
        raise Reject("unsupported-registry-version", "registry-version", 26, version["offset"])
    for ordinal in range(counted(29, "registry-count")):
        r.scope = (ordinal, None)
        rid = r.scalar(nodes, 31)
        names = tuple(r.string(nodes, k)["bytes"] for k in (33, 37, 41))
        if names == TERMINATOR:
            raise Reject("unsupported-terminator", "reference-identity", ordinal, rid["offset"])
        matches = by_name.get(names, [])
        entry = {"ordinal": ordinal, "rid": rid["bits"], "class_name": names[0], "name_space": names[1], "assembly": names[2], "match_count": len(matches), "kind": "selected-payload", "ref_type": None, "payload_offset": r.c.at}
        if not matches and not any(names):
            if rid["bits"] != NULL_RID:
                raise Reject("unsupported-null-row", "reference-identity", ordinal, rid["offset"])
            entry["kind"] = "null"
        elif len(matches) != 1:
            raise Reject("reference-type-missing" if not matches else "reference-type-ambiguous", "reference-identity", ordinal, rid["offset"])
        else:
            entry["ref_type"] = matches[0]
            ref, own = ref_types[matches[0]]
            hashed = ref["class_id"] == -1 and not ref["stripped_raw"] and ref["script_index"] >= 0
            is_text, is_float = has_shape(own, [*PAYLOAD_TEXT, *REGISTRY]), has_shape(own, [*PAYLOAD_FLOAT, *REGISTRY])
            if not hashed or not (is_text or is_float):
                raise Reject("unsupported-schema", "reference-type", matches[0])
            r.scope = (ordinal, matches[0])
            r.scalar(own, 1)
            if is_text:
                r.string(own, 2)
                slot(own, 7)
            else:
                r.scalar(own, 2, "float32")
                slot(own, 4)
        entry["payload_size"] = r.c.at - entry["payload_offset"]
        rows.append(entry)
        r.scope = (None, None)
    r.finish()
    return {"values": r.values, "rows": rows, "slots": slots, "array_elements": elements}
