"""Byte builders for synthetic inputs, independent of the decoders."""

import lzma
import struct


class Out:
    def __init__(self, big=False):
        self.data, self.order = bytearray(), ">" if big else "<"

    def put(self, kinds, *values):
        self.data += struct.pack(self.order + kinds, *values)
        return self

    def raw(self, data):
        self.data += data
        return self

    def align(self, width, origin=0):
        self.data += bytes(-(len(self.data) - origin) % width)
        return self


def strings(*names):
    """A local string table and the offset of each name."""
    table, at = b"", {}
    for name in names:
        at[name] = len(table)
        table += name.encode() + b"\0"
    return table, at


def tree(nodes, big=False):
    """Node records and string table from (type, field, level, flags, size, meta)."""
    names = list(dict.fromkeys(n for node in nodes for n in node[:2]))
    table, at = strings(*names)
    out = Out(big)
    for k, (kind, field, level, flags, size, meta) in enumerate(nodes):
        out.put("HBBIIiII", 1, level, flags, at[kind], at[field], size, k, meta).raw(bytes(8))
    return bytes(out.data), table


def type_row(out, class_id, script_index=-1, nodes=None, deps=(), type_hash=b"h" * 16, reference=None, stripped=0, script_hash=b"s" * 16):
    out.put("iBh", class_id, stripped, script_index)
    if class_id == 114 or script_index >= 0:
        out.raw(script_hash)
    out.raw(type_hash)
    if nodes is not None:
        raw, table = tree(nodes, out.order == ">")
        out.put("II", len(nodes), len(table)).raw(raw).raw(table)
        if reference is None:
            out.put("i", len(deps))
            out.put(f"{len(deps)}i", *deps)
        else:
            for name in reference:
                out.raw(name.encode() + b"\0")


def serialized(types, objects, payload, scripts=(), externals=(), refs=(), user=b"", big=False, version=b"2021.3.35f1", target=19):
    """A v22 file.  types: kwargs of type_row; objects: (path_id, offset, size, type)."""
    with_tree = any(t.get("nodes") is not None for t in (*types, *refs))
    out = Out(big)
    out.raw(version + b"\0").put("IB", target, with_tree).put("i", len(types))
    for t in types:
        type_row(out, **t)
    out.put("i", len(objects))
    if objects:
        out.align(4)
    for path_id, offset, size, kind in objects:
        out.put("qQII", path_id, offset, size, kind)
    out.put("i", len(scripts))
    for index, local in scripts:
        out.put("i", index).align(4).put("q", local)
    out.put("i", len(externals))
    for virtual, guid, kind, path in externals:
        out.raw(virtual + b"\0").raw(guid).put("i", kind).raw(path + b"\0")
    out.put("i", len(refs))
    for t in refs:
        type_row(out, **t)
    out.raw(user + b"\0")
    data_offset = -(-(48 + len(out.data)) // 16) * 16
    size = data_offset + len(payload)
    head = struct.pack(">IIII", 0, 0, 22, 0) + struct.pack(">QQQ", len(out.data), size, data_offset) + bytes([big]) + bytes(7)
    return (head + bytes(out.data)).ljust(data_offset, b"\0") + payload


def lz4_literals(data):
    """An LZ4 block of literals only."""
    n, out = len(data), bytearray()
    out.append(min(n, 15) << 4)
    if n >= 15:
        n -= 15
        while n >= 255:
            out.append(255)
            n -= 255
        out.append(n)
    return bytes(out) + data


def lzma_block(data):
    filters = [{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}]
    alone = lzma.compress(data, lzma.FORMAT_ALONE, filters=filters)
    return alone[:5] + alone[13:]


PACK = {0: lambda d: d, 1: lzma_block, 2: lz4_literals, 3: lz4_literals}


def bundle(members, kind=0, at_end=False, padded=False):
    """An archive of (name, flags, data), one block per member."""
    payload, directory, blocks, packed, at = b"", b"", b"", b"", 0
    for name, flags, data in members:
        body = PACK[kind](data)
        blocks += struct.pack(">IIH", len(data), len(body), kind)
        packed += body
        directory += struct.pack(">QQI", at, len(data), flags) + name + b"\0"
        at += len(data)
    info = bytes(16) + struct.pack(">I", len(members)) + blocks + struct.pack(">I", len(members)) + directory
    body = PACK[kind](info)
    flags = kind | 0x40 | (0x80 if at_end else 0) | (0x200 if padded else 0)
    lead = b"UnityFS\0" + struct.pack(">I", 8) + b"5.x.x\0" + b"2021.3.35f1\0"
    head_size = -(-(len(lead) + 20) // 16) * 16
    if at_end:
        rest = packed + body
    else:
        start = head_size + len(body)
        rest = body + (bytes(-start % 16) if padded else b"") + packed
    total = head_size + len(rest)
    head = lead + struct.pack(">QIII", total, len(body), len(info), flags)
    return head.ljust(head_size, b"\0") + rest


SIMPLE = [("Thing", "Base", 0, 0, -1, 0), ("int", "number", 1, 0, 4, 0), ("string", "label", 1, 0, -1, 0), ("Array", "Array", 2, 1, -1, 0x4000), ("int", "size", 3, 0, 4, 0), ("char", "data", 3, 0, 1, 0), ("vector", "bytes", 1, 0, -1, 0), ("Array", "Array", 2, 1, -1, 0x4000), ("int", "size", 3, 0, 4, 0), ("UInt8", "data", 3, 0, 1, 0)]


def simple_payload(number, label, raw, big=False):
    out = Out(big).put("iI", number, len(label)).raw(label).align(4)
    return bytes(out.put("I", len(raw)).raw(raw).align(4).data)
