"""Archives: block table, member directory and the concatenated payload.

Blocks are stored, LZMA or LZ4.  Sizes must match exactly: the blocks cover the data region
without a gap, a block gives as many bytes as it declares and uses all it has, and every
member lies inside the payload.
"""

from __future__ import annotations

import lzma

from .container import ENGINE
from .cursor import Cursor, Reject

# Fixed values of the format.
SIGNATURE, VERSION, GENERATION = b"UnityFS", 8, b"5.x.x"
COMPRESSION, COMBINED, INFO_AT_END, PADDED = 0x3F, 0x40, 0x80, 0x200
BLOCK_STREAMING = 0x40
MEMBER_DIRECTORY, MEMBER_DELETED, MEMBER_SERIALIZED = 1, 2, 4
RESOURCE_SUFFIXES = (b".resS", b".resource", b".resources")
#: The last literals of an LZ4 block, and how far its last match starts before the end.
LZ4_TAIL, LZ4_LAST_MATCH = 5, 12


def _lz4_length(block: bytes, at: int, n: int) -> tuple[int, int]:
    if n == 15:
        while True:
            if at >= len(block):
                raise Reject("lz4-truncated", "length", None, at)
            n, at = n + block[at], at + 1
            if block[at - 1] != 255:
                break
    return n, at


def lz4(block: bytes, capacity: int, exact: bool = False) -> bytes:
    """Decode one LZ4 block into at most ``capacity`` bytes.  ``exact`` asks for a full
    output and for the format's rules on how a block ends."""
    out, at, match_at = bytearray(), 0, None
    while at < len(block):
        token, at = block[at], at + 1
        n, at = _lz4_length(block, at, token >> 4)
        if n > len(block) - at or n > capacity - len(out):
            raise Reject("lz4-overrun", "literals", None, at)
        out += block[at: at + n]
        at += n
        if at == len(block):
            ends_well = match_at is None or n >= LZ4_TAIL and len(out) - match_at >= LZ4_LAST_MATCH
            if exact and not (len(out) == capacity and ends_well):
                raise Reject("lz4-bad-end", "end", None, at)
            return bytes(out)
        if len(block) - at < 2:
            raise Reject("lz4-truncated", "offset", None, at)
        back, at = block[at] | block[at + 1] << 8, at + 2
        if not 0 < back <= len(out):
            raise Reject("lz4-bad-offset", "offset", None, at)
        n, at = _lz4_length(block, at, token & 15)
        n += 4
        if n > capacity - len(out):
            raise Reject("lz4-overrun", "match", None, at)
        match_at = len(out)
        seed = bytes(out[match_at - back:])  # repeats itself where the match overlaps its own output
        out += (seed * (n // back + 1))[:n]
    if exact:
        raise Reject("lz4-bad-end", "end", None, at)
    return bytes(out)


def raw_lzma(block: bytes, size: int) -> bytes:
    """Decode LZMA1 data after its five property bytes into exactly ``size`` bytes, using up
    all of the block."""
    if len(block) < 5:
        raise Reject("lzma-truncated", "properties", None, 0)
    properties = block[0]
    if properties >= 225:
        raise Reject("lzma-bad-properties", "properties", None, 0)
    options = {"id": lzma.FILTER_LZMA1, "dict_size": max(4096, int.from_bytes(block[1:5], "little")), "lc": properties % 9, "lp": properties // 9 % 5, "pb": properties // 45}
    # As a file with a known size the decoder stops there, and tells what it didn't use.
    alone = block[:5] + size.to_bytes(8, "little") + block[5:]
    try:
        reader = lzma.LZMADecompressor(lzma.FORMAT_ALONE)
        out = reader.decompress(alone)
        if reader.eof and not reader.unused_data and len(out) == size:
            return out
        # An end mark may follow; then the size is left open.
        reader = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[options])
        out = reader.decompress(block[5:])
    except (lzma.LZMAError, ValueError) as error:
        raise Reject("lzma-malformed", "block", None, 5) from error
    if not reader.eof or reader.unused_data or len(out) != size:
        raise Reject("lzma-size-mismatch", "block", None, 5)
    return out


def unpack(kind: int, block: bytes, size: int) -> bytes:
    if kind == 0:
        if len(block) != size:
            raise Reject("stored-size-mismatch", "block")
        return block
    if kind == 1:
        return raw_lzma(block, size)
    if kind in (2, 3):
        if not block:
            out = b""
        else:
            out = lz4(block, size)
        if len(out) != size:
            raise Reject("lz4-size-mismatch", "block")
        return out
    raise Reject("unsupported-compression", "block")


def classify(flags: int, name: bytes) -> str:
    """What a member is, from its flags and name."""
    if flags & ~(MEMBER_DIRECTORY | MEMBER_DELETED | MEMBER_SERIALIZED):
        return "invalid"
    if flags & MEMBER_SERIALIZED:
        return "invalid" if flags & (MEMBER_DIRECTORY | MEMBER_DELETED) else "serialized-file"
    if flags & MEMBER_DIRECTORY:
        return "invalid" if flags & MEMBER_DELETED else "directory"
    if flags & MEMBER_DELETED:
        return "deleted"
    return "resource" if name.endswith(RESOURCE_SUFFIXES) else "invalid"


def open_archive(data: bytes) -> dict:
    """Header fields, ``blocks``, and ``members`` with their bytes."""
    c = Cursor(data, big=True)
    c.field = "signature"
    head = {"signature": c.text()}
    if head["signature"] != SIGNATURE:
        raise Reject("unsupported-signature", "signature", None, 0)
    c.field = "header"
    head |= {"version": c.u32(), "generation": c.text(), "engine": c.text()}
    if (head["version"], head["generation"], head["engine"]) != (VERSION, GENERATION, ENGINE):
        raise c.fail("unsupported-dialect")
    head |= {"total_size": c.u64(), "info_csize": c.u32(), "info_usize": c.u32(), "flags": c.u32()}
    flags = head["flags"]
    if not flags & COMBINED or flags & ~(COMPRESSION | COMBINED | INFO_AT_END | PADDED) or flags & COMPRESSION > 3:
        raise c.fail("unsupported-flags")
    if head["total_size"] != len(data) or not head["info_csize"] or head["info_usize"] < 20:
        raise c.fail("size-mismatch")
    c.align(16)
    info_at = len(data) - head["info_csize"] if flags & INFO_AT_END else c.at
    if info_at < c.at or head["info_csize"] > len(data) - info_at:
        raise Reject("info-out-of-bounds", "block-info", None, info_at)
    info = Cursor(unpack(flags & COMPRESSION, data[info_at: info_at + head["info_csize"]], head["info_usize"]), 16)
    info.field = "blocks"
    n = info.u32()
    if n > info.left // 10:
        raise info.fail("count-too-large")
    blocks = []
    for k in range(n):
        blocks.append({"ordinal": k, "usize": info.u32(), "csize": info.u32(), "flags": info.u16()})
        if blocks[-1]["flags"] & ~(COMPRESSION | BLOCK_STREAMING) or blocks[-1]["flags"] & COMPRESSION > 3:
            raise info.fail("unsupported-block-flags")
    info.field = "members"
    n = info.u32()
    if n > info.left // 21:
        raise info.fail("count-too-large")
    members = [{"ordinal": k, "offset": info.u64(), "size": info.u64(), "flags": info.u32(), "name": info.text()} for k in range(n)]
    if info.left:
        raise info.fail("trailing-info")
    start, stop = (c.at, info_at) if flags & INFO_AT_END else (info_at + head["info_csize"], len(data))
    if flags & PADDED:
        start += -start % 16
    if start > stop or sum(b["csize"] for b in blocks) != stop - start:
        raise Reject("coverage-mismatch", "data", None, start)
    parts, at = [], start
    for b in blocks:
        parts.append(unpack(b["flags"] & COMPRESSION, data[at: at + b["csize"]], b["usize"]))
        at += b["csize"]
    payload = b"".join(parts)
    for m in members:
        if m["offset"] > len(payload) or m["size"] > len(payload) - m["offset"]:
            raise Reject("member-out-of-bounds", "members", m["ordinal"], m["offset"])
        m |= {"kind": classify(m["flags"], m["name"]), "data": payload[m["offset"]: m["offset"] + m["size"]]}
    return head | {"blocks": blocks, "members": members}
