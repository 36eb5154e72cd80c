"""Writing the formats that the decoders read: for carrier queries and round-trip checks.

Only what the decoders accept can be written; offsets, counts and padding are derived.
"""

from __future__ import annotations

import lzma
import struct

from .archive import GENERATION, SIGNATURE, VERSION
from .container import ENGINE, FORMAT, HEADER_BYTES, carries_script_hash


def _padded(data: bytes, width: int) -> bytes:
    return data + bytes(-len(data) % width)


def schema_block(fields: list[tuple], big: bool = False) -> bytes:
    """Node count, string size, nodes and strings of (type, name, level, byte size, meta flags)
    and, where given, type flags."""
    order = ">" if big else "<"
    starts: dict[str, int] = {}
    table = b""
    for name in (x for f in fields for x in f[:2]):
        if name not in starts:
            starts[name] = len(table)
            table += name.encode() + b"\0"
    nodes = b"".join(
        struct.pack(order + "HBBIIiII8x", 1, level, flags[0] if flags else 0, starts[kind], starts[name], size, k, meta)
        for k, (kind, name, level, size, meta, *flags) in enumerate(fields))
    return struct.pack(order + "II", len(fields), len(table)) + nodes + table


def _type_row(order: str, class_id: int, type_hash: bytes, script_index: int = -1) -> bytes:
    hashed = carries_script_hash(class_id, script_index)
    return struct.pack(order + "iBh", class_id, 0, script_index) + (type_hash if hashed else b"") + type_hash


def serialized_file(types: list[tuple], objects: list[tuple[int, int, int, int]], payload: bytes,
                    externals: list[tuple[bytes, bytes, int, bytes]] = (), scripts: list[tuple[int, int]] = (), big: bool = False,
                    references: list[tuple] = ()) -> bytes:
    """types: (class id, type hash, schema block or None) and, where given, script index; objects:
    (path id, offset, size, type); externals: (virtual path, guid, type, path name); scripts:
    (file index, path id); references: (type hash, schema block, class name, name space, assembly).
    A row with a script has its type's hash as script hash."""
    order = ">" if big else "<"
    trees = any(block is not None for _, _, block, *_ in types)
    meta = bytearray(ENGINE + b"\0" + struct.pack(order + "IBi", 19, trees, len(types)))
    for class_id, type_hash, block, *script in types:
        meta += _type_row(order, class_id, type_hash, *script)
        if trees:
            meta += block + struct.pack(order + "i", 0)
    meta += struct.pack(order + "i", len(objects))
    if objects:
        meta += bytes(-len(meta) % 4)
    for row in objects:
        meta += struct.pack(order + "qQII", *row)
    meta += struct.pack(order + "i", len(scripts))
    for index, path_id in scripts:
        meta += struct.pack(order + "i", index)
        meta += bytes(-len(meta) % 4) + struct.pack(order + "q", path_id)
    meta += struct.pack(order + "i", len(externals))
    for virtual, guid, kind, name in externals:
        meta += virtual + b"\0" + guid + struct.pack(order + "i", kind) + name + b"\0"
    meta += struct.pack(order + "i", len(references))
    for k, (type_hash, block, *names) in enumerate(references):
        meta += _type_row(order, -1, type_hash, k) + (block or b"")
        if trees:
            meta += b"".join(name + b"\0" for name in names)
    meta += b"\0"
    start = HEADER_BYTES + len(meta) + -(HEADER_BYTES + len(meta)) % 16
    head = struct.pack(">8xI4xQQQB7x", FORMAT, len(meta), start + len(payload), start, big)
    return (head + bytes(meta)).ljust(start, b"\0") + payload


def lz4_block(data: bytes) -> bytes:
    """An LZ4 block of literals, with a run of one byte as a match where the data starts with one."""
    run = len(data) - len(data.lstrip(data[:1]))
    out = b""
    if run >= 24 and len(data) - run >= 12:
        n = run - 1 - 4
        out = bytes([0x1F if n >= 15 else 0x10 | n]) + data[:1] + b"\x01\x00" + _lz4_rest(n)
        data = data[run:]
    return out + bytes([min(len(data), 15) << 4]) + _lz4_rest(len(data)) + data


def _lz4_rest(n: int) -> bytes:
    return b"" if n < 15 else b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255])


def lzma_block(data: bytes) -> bytes:
    """Five bytes of properties and raw LZMA1 data, which ends with its last byte."""
    filters = [{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}]
    alone = lzma.compress(data, lzma.FORMAT_ALONE, filters=filters)
    return alone[:5] + alone[13:]


def archive(members: list[tuple[bytes, int, bytes]], compressed: bool | int = False) -> bytes:
    """An archive of (name, flags, data), a block for each member: stored, LZMA (1) or LZ4
    (2, or true)."""
    kind = 2 if compressed is True else int(compressed)
    pack = (bytes, lzma_block, lz4_block)[kind]
    directory, blocks, body, at = b"", b"", b"", 0
    for name, flags, data in members:
        block = pack(data) if data else b""
        blocks += struct.pack(">IIH", len(data), len(block), kind if data else 0)
        directory += struct.pack(">QQI", at, len(data), flags) + name + b"\0"
        body, at = body + block, at + len(data)
    info = bytes(16) + struct.pack(">I", len(members)) + blocks + struct.pack(">I", len(members)) + directory
    packed = pack(info)
    lead = SIGNATURE + b"\0" + struct.pack(">I", VERSION) + GENERATION + b"\0" + ENGINE + b"\0"
    head_size = len(_padded(lead + bytes(20), 16))
    head = lead + struct.pack(">QIII", head_size + len(packed) + len(body), len(packed), len(info), kind | 0x40)
    return head.ljust(head_size, b"\0") + packed + body
