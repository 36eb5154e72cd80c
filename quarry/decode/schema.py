"""Self-described schemas: nodes, their names, tree links, grammar, and values they decode."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

from .container import NODE_BYTES
from .cursor import Cursor, Reject

# The names of the common string table, in the order of the table.
COMMON_NAMES = (
    "AABB|AnimationClip|AnimationCurve|AnimationState|Array|Base|BitField|bitset|bool|char|ColorRGBA|Component|data|deque|double|"
    "dynamic_array|FastPropertyName|first|float|Font|GameObject|Generic Mono|GradientNEW|GUID|GUIStyle|int|list|long long|map|"
    "Matrix4x4f|MdFour|MonoBehaviour|MonoScript|m_ByteSize|m_Curve|m_EditorClassIdentifier|m_EditorHideFlags|m_Enabled|"
    "m_ExtensionPtr|m_GameObject|m_Index|m_IsArray|m_IsStatic|m_MetaFlag|m_Name|m_ObjectHideFlags|m_PrefabInternal|"
    "m_PrefabParentObject|m_Script|m_StaticEditorFlags|m_Type|m_Version|Object|pair|PPtr<Component>|PPtr<GameObject>|"
    "PPtr<Material>|PPtr<MonoBehaviour>|PPtr<MonoScript>|PPtr<Object>|PPtr<Prefab>|PPtr<Sprite>|PPtr<TextAsset>|PPtr<Texture>|"
    "PPtr<Texture2D>|PPtr<Transform>|Prefab|Quaternionf|Rectf|RectInt|RectOffset|second|set|short|size|SInt16|SInt32|SInt64|SInt8|"
    "staticvector|string|TextAsset|TextMesh|Texture|Texture2D|Transform|TypelessData|UInt16|UInt32|UInt64|UInt8|unsigned int|"
    "unsigned long long|unsigned short|vector|Vector2f|Vector3f|Vector4f|m_ScriptingClassIdentifier|Gradient|Type*|int2_storage|"
    "int3_storage|BoundsInt|m_CorrespondingSourceObject|m_PrefabInstance|m_PrefabAsset|FileSize|Hash128"
)
COMMON_TABLE = b"".join(name.encode() + b"\0" for name in COMMON_NAMES.split("|")) + b"\0"
COMMON_BIT = 0x80000000

# Scalar type names by width; floats are floats, "SInt*", int, short, long long are signed.
WIDTHS = {
    1: "SInt8 UInt8 bool char".split(" "),
    2: ["SInt16", "UInt16", "short", "unsigned short"],
    4: ["SInt32", "UInt32", "int", "unsigned int", "RenderingLayerMask", "Type*", "BitField", "float"],
    8: ["SInt64", "UInt64", "long long", "unsigned long long", "FileSize", "double"],
}
WIDTH_OF = {name.encode(): width for width, names in WIDTHS.items() for name in names}
SIGNED = frozenset(x for x in WIDTH_OF if x.startswith(b"SInt") or x in (b"int", b"short", b"long long"))
FLOATS = frozenset((b"float", b"double"))
ALIGN_FLAG = 0x4000
REGISTRY_FLAG = 0x04


@dataclass
class Node:
    version: int
    level: int
    type_flags: int
    type_offset: int
    name_offset: int
    byte_size: int
    index: int
    meta_flags: int
    opaque: bytes
    type_name: bytes | None = None
    field_name: bytes | None = None
    parent: int | None = None
    first_child: int | None = None
    next_sibling: int | None = None
    child_count: int = 0
    subtree_end: int = 0


def read_nodes(raw: bytes, big: bool) -> list[Node]:
    c = Cursor(raw, big=big)
    return [
        Node(c.u16(), c.u8(), c.u8(), c.u32(), c.u32(), c.i32(), c.u32(), c.u32(), c.take(8))
        for _ in range(len(raw) // NODE_BYTES)
    ]


def name_at(offset: int, strings: bytes) -> bytes | None:
    """The string that starts exactly at an offset of the local or, by its high bit, common table."""
    table, at = (COMMON_TABLE, offset - COMMON_BIT) if offset & COMMON_BIT else (strings, offset)
    stop = table.find(b"\0", at) if at < len(table) else -1
    return None if stop < 0 or at and table[at - 1] else table[at:stop]


def bind(nodes: list[Node], strings: bytes) -> None:
    for k, node in enumerate(nodes):
        node.type_name, node.field_name = name_at(node.type_offset, strings), name_at(node.name_offset, strings)
        if node.type_name is None or node.field_name is None:
            raise Reject("unresolved-string", "type-name" if node.type_name is None else "field-name", k)


def link(nodes: list[Node]) -> None:
    """Parents, children, siblings and subtree ends from preorder levels, in one pass."""
    open_: list[int] = []  # the path from the root to the last node
    last_child: dict[int | None, int] = {}
    for k, node in enumerate(nodes):
        if node.level > len(open_) or (node.level == 0) != (k == 0):
            raise Reject("malformed-hierarchy", "level", k)
        for closed in open_[node.level:]:
            nodes[closed].subtree_end = k
        del open_[node.level:]
        node.parent = open_[-1] if open_ else None
        if node.parent is not None:
            parent = nodes[node.parent]
            parent.child_count += 1
            if parent.first_child is None:
                parent.first_child = k
            else:
                nodes[last_child[node.parent]].next_sibling = k
            last_child[node.parent] = k
        open_.append(k)
    for closed in open_:
        nodes[closed].subtree_end = len(nodes)


def children(nodes: list[Node], k: int) -> list[int]:
    out, at = [], nodes[k].first_child
    while at is not None:
        out.append(at)
        at = nodes[at].next_sibling
    return out


def _is_array(node: Node) -> bool:
    return b"Array" in (node.type_name, node.field_name)


def grammar_error(nodes: list[Node]) -> int | None:
    """The first node that breaks the grammar of schemas whose values can be decoded.

    Every node has names and a size of -1 or more.  A node whose type is a scalar has that
    scalar's width and nothing below it.  An array is a node ``Array Array`` of no fixed size
    that comes first below its owner and holds just an ``int size`` and something ``data``.
    A string owns an array of one-byte chars.  Whatever else has nothing below it has no known
    width.  A node that owns a broken array is itself broken.
    """
    below: dict[int, list[int]] = {k: [] for k in range(len(nodes))}
    for k, n in enumerate(nodes):
        if n.parent is not None:
            below[n.parent].append(k)
    leaf = lambda k, name, width: (nodes[k].type_name, nodes[k].byte_size, below[k]) == (name, width, [])
    strings = {k for k, n in enumerate(nodes) if n.type_name == b"string"}
    arrays = {
        k for k, n in enumerate(nodes) if (n.type_name, n.field_name, n.byte_size) == (b"Array", b"Array", -1) and n.parent == k - 1
        and [nodes[c].field_name for c in below[k]] == [b"size", b"data"] and leaf(below[k][0], b"int", 4)}
    arrays -= {k for k in arrays if k - 1 in strings and not leaf(below[k][1], b"char", 1)}
    called_arrays = {k for k, n in enumerate(nodes) if _is_array(n)}
    scalars = {k for k, n in enumerate(nodes) if n.type_name in WIDTH_OF}
    owners = {k for k in below if below[k] and below[k][0] in called_arrays}
    broken = (
        {k for k, n in enumerate(nodes) if not n.type_name or not n.field_name or n.byte_size < -1}
        | {k for k in scalars if not leaf(k, nodes[k].type_name, WIDTH_OF[nodes[k].type_name])}
        | (called_arrays - arrays)
        | {k for k in strings if nodes[k].byte_size != -1}
        | {k for k in strings | owners if not below[k] or below[k][0] not in arrays}
        | {k for k in below if not below[k] and k not in scalars and nodes[k].type_name != b"Array"})
    return min(broken, default=None)


def compile_schema(raw: bytes, strings: bytes, big: bool) -> list[Node]:
    """Nodes with names and links; refuses unresolved names and a broken hierarchy."""
    nodes = read_nodes(raw, big)
    if not nodes:
        raise Reject("empty-schema", "tree")
    bind(nodes, strings)
    link(nodes)
    return nodes


def context(nodes: list[Node], selected: bool) -> dict:
    """How far a traversal goes: a registry node must be the sole last direct child; values of
    an ordinary object include it, a selected payload stops before it."""
    registry = None
    for k, node in enumerate(nodes):
        if not node.type_flags & REGISTRY_FLAG:
            continue
        if node.type_flags != REGISTRY_FLAG:
            raise Reject("unsupported-registry-flags", "type-flags", k)
        if node.parent != 0 or node.next_sibling is not None or node.subtree_end != len(nodes) or registry is not None:
            raise Reject("unsupported-registry-position", "level", k)
        registry = k
    omitted = selected and registry is not None
    return {
        "kind": "selected-reference-payload" if selected else "ordinary-object", "traversal_end": registry if omitted else len(nodes),
        "registry": registry, "registry_end": None if registry is None else nodes[registry].subtree_end, "registry_omitted": omitted}


@dataclass
class Value:
    """A decoded value: int, float, string, struct, array or none."""

    kind: str
    name: bytes
    type_name: bytes
    number: int | float | None = None
    unsigned: bool = False
    text: bytes | None = None
    items: list[Value] = field(default_factory=list)
    packed: bytes | None = None


def parse_value(nodes: list[Node], data: bytes, big: bool, pack: bool = False) -> tuple[Value, int]:
    """The value of node 0 and the bytes it took.  ``pack`` keeps arrays of UInt8 as bytes.
    Alignment counts from the start of the object."""
    c = Cursor(data, big=big)

    def read(k: int, element: bool) -> Value:
        node = nodes[k]
        value = Value("none", node.field_name, node.type_name)
        aligned = not element and bool(node.meta_flags & ALIGN_FLAG)
        if not node.child_count:
            width = WIDTH_OF.get(node.type_name)
            if width is None or width != node.byte_size:
                raise Reject("unsupported-leaf", "value", k, c.at)
            c.field, c.row = "value", k
            raw = c.take(width)
            if node.type_name in FLOATS:
                value.kind = "float"
                value.number = struct.unpack(c.order + ("f" if width == 4 else "d"), raw)[0]
            else:
                value.kind, value.unsigned = "int", node.type_name not in SIGNED
                value.number = int.from_bytes(raw, "big" if big else "little", signed=not value.unsigned)
        elif node.type_name == b"string":
            c.field, c.row = "string", k
            value.kind, value.text = "string", c.take(c.u32())
            aligned = True
        elif _is_array(nodes[k + 1]):
            value.kind = "array"
            c.field, c.row = "array", k
            at, n = c.at, c.u32()
            if n > 0x7FFFFFFF or n > c.left:
                raise Reject("impossible-count", "array", k, at)
            data_at = children(nodes, k + 1)[1]
            item = nodes[data_at]
            if pack and item.type_name == b"UInt8" and item.byte_size == 1 and not item.child_count:
                value.packed = c.take(n)
            else:
                value.items = [read(data_at, True) for _ in range(n)]
            aligned |= bool((nodes[k + 1].meta_flags | item.meta_flags) & ALIGN_FLAG)
        else:
            value.kind = "struct"
            value.items = [read(child, False) for child in children(nodes, k)]
        if aligned:
            c.align(4)
        return value

    found = read(0, False)
    return found, c.at


def flatten(value: Value) -> list[dict]:
    """Rows of a value in preorder: its path, depth, kind and scalar."""
    out: list[dict] = []

    def walk(v: Value, path: str, depth: int) -> None:
        n = len(v.packed) if v.packed is not None else len(v.items)
        row = {"ordinal": len(out), "path": path, "depth": depth, "kind": v.kind, "type_name": v.type_name.decode("utf-8", "replace"), "int_value": None, "uint_value": None, "double_value": None, "bytes_value": None, "count": n if v.kind in ("struct", "array") else None}
        if v.kind == "int":
            row["uint_value" if v.unsigned else "int_value"] = v.number
        elif v.kind == "float":
            row["double_value"] = v.number
        else:
            row["bytes_value"] = v.text if v.kind == "string" else v.packed
        out.append(row)
        for i, item in enumerate(v.items):
            step = str(i) if v.kind == "array" else item.name.decode("utf-8", "replace")
            walk(item, f"{path}/{step}" if path else step, depth + 1)

    walk(value, "", 0)
    return out


def find_path(value: Value | None, path: str) -> Value | None:
    """The member that a path of names, split at / and ., leads to; structs only."""
    for step in path.replace(".", "/").split("/"):
        if step:
            if value is None or value.kind != "struct":
                return None
            value = next((x for x in value.items if x.name == step.encode()), None)
    return value


def get_array(value: Value | None) -> Value | None:
    while value is not None and value.kind != "array":
        inner = find_path(value, "Array")
        if inner is not None and inner.kind == "array":
            return inner
        value = find_path(value, "data")
    return value


def as_int(value: Value | None) -> int | None:
    """The value as a signed 64-bit integer, None if it isn't one."""
    ok = value is not None and value.kind == "int" and value.number < 1 << 63
    return value.number if ok else None


def as_uint(value: Value | None) -> int | None:
    """The value as an unsigned integer, None for negative ones and other kinds."""
    ok = value is not None and value.kind == "int" and value.number >= 0
    return value.number if ok else None


# Numbers of the kinds in a value's digest.
KIND_NUMBERS = {"int": 0, "float": 1, "string": 2, "array": 3, "struct": 4, "none": 5}
DIGEST_DOMAIN = b"OrderedTypeTreeValue.v1"
MAX_DEPTH, MAX_VALUES, MAX_STRING = 256, 1_048_576, 16 << 20


def value_digest(value: Value, domain: bytes = DIGEST_DOMAIN) -> str:
    """SHA-256 over a value in order.  Packed and expanded arrays of UInt8 are equal; floats
    go by their 64 bits.  Digests compare only within one ``domain``."""
    h, room = hashlib.sha256(domain + b"\0"), MAX_VALUES
    word = lambda n: h.update((n & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"))

    def string(text: bytes) -> None:
        if len(text) > MAX_STRING or b"\0" in text:
            raise Reject("digest-string", "value")
        word(len(text))
        h.update(text)

    def walk(v: Value, depth: int) -> None:
        nonlocal room
        if depth >= MAX_DEPTH or not room:
            raise Reject("digest-limit", "value")
        room -= 1
        word(KIND_NUMBERS[v.kind])
        string(v.name)
        string(v.type_name)
        if v.kind == "int":
            word(v.unsigned)
            word(v.number)
        elif v.kind == "float":
            word(struct.unpack("<Q", struct.pack("<d", v.number))[0])
        elif v.kind == "string":
            string(v.text)
        elif v.kind in ("struct", "array"):
            n = len(v.packed) if v.packed is not None else len(v.items)
            if n > room:
                raise Reject("digest-limit", "value")
            word(n)
            if v.kind == "array":
                plain = v.packed is not None or all(x.kind == "int" and x.unsigned and x.number < 256 and x.type_name == b"UInt8" for x in v.items)
                word(plain)
                if plain:
                    room -= n
                    h.update(v.packed if v.packed is not None else bytes(x.number for x in v.items))
                    return
            for x in v.items:
                walk(x, depth + 1)

    walk(value, 0)
    return h.hexdigest()


# Fixed value: what a shape digest starts with.
SHAPE_DOMAIN = b"DXBCSandbox.TypeTreeSemanticShape.v1\0"


def shape_digest(row: dict, nodes: list[Node], reference: bool = False) -> str:
    """SHA-256 over a type's identity and its resolved nodes; string offsets don't count."""
    text = lambda s: struct.pack("<I", len(s)) + s
    parts = [SHAPE_DOMAIN, struct.pack("<iBH", row["class_id"], bool(row["stripped_raw"]), row["script_index"] & 0xFFFF)]
    parts += [row["script_hash"] or bytes(16), row["type_hash"], struct.pack("<I", len(nodes))]
    for n in nodes:
        parts.append(struct.pack("<HBBiII", n.version, n.level, n.type_flags, n.byte_size, n.index, n.meta_flags) + n.opaque)
        parts += [text(n.type_name), text(n.field_name)]
    dependencies = row.get("dependencies") or []
    parts.append(struct.pack(f"<I{len(dependencies)}i", len(dependencies), *dependencies))
    parts.append(bytes([reference]))
    if reference:
        parts += [text(row[k] or b"") for k in ("class_name", "name_space", "assembly")]
    return hashlib.sha256(b"".join(parts)).hexdigest()


# Engine version, class, type hash and shape digest of the schemas known to be right.
KNOWN_SHAPES = {
    ("2021.3.35f1", 21, "c60098aca6a28b50aa0580db11bf018c"): "7c4d49a6d78e0dd296ae763268136982852f7a62ae8cde85392ec0fa8dbb998c",
    ("2021.3.35f1", 48, "f0c184272a05e54447e36366ec4876a6"): "b7fed865d864aaeaa797dd365f1c646e16afccbdc045755e9f6a8379b3d87bfb",
    ("2021.3.35f1", 142, "97da5f4688e45a57c8b42d4f42497297"): "01e56d4d77bcda8f7e6c3572618b5a060e015cb38fc45d8064c133d261a1d2d1",
    ("2021.3.29f1", 48, "f0c184272a05e54447e36366ec4876a6"): "b7fed865d864aaeaa797dd365f1c646e16afccbdc045755e9f6a8379b3d87bfb",
    ("2021.3.29f1", 21, "c60098aca6a28b50aa0580db11bf018c"): "7c4d49a6d78e0dd296ae763268136982852f7a62ae8cde85392ec0fa8dbb998c",
}


def known_profile(engine: str, class_id: int, type_hash: bytes, digest: str) -> str:
    want = KNOWN_SHAPES.get((engine, class_id, type_hash.hex()))
    return "unknown" if want is None else "valid" if want == digest else "invalid"
