"""The build-settings object of a player: one per file, of one exact type."""

from __future__ import annotations

from .container import ENGINE, File
from .cursor import Cursor, Reject

# Class and type hash of the object, and its booleans in the order of the bytes.
CLASS = 141
TYPE_HASH = bytes.fromhex("575bf9902bd61f97e962a3a175b5c67a")
FLAGS = (
    "has_pro_version is_no_watermark_build is_prototyping_build is_educational_build is_embedded is_trial has_publishing_rights "
    "has_shadows has_soft_shadows has_local_light_shadows has_advanced_version enable_dynamic_batching is_debug_build "
    "uses_on_mouse_events has_cluster_rendering").split()


def _align(c: Cursor) -> None:
    at = c.at
    if any(c.align(4)):
        raise c.fail("alignment-invalid", at)


def _string(c: Cursor) -> bytes:
    start, c.short = c.at, "string-truncated"
    n = c.i32()
    if n < 0:
        raise c.fail("string-length-invalid", start)
    text = c.take(n)
    if b"\0" in text:
        raise c.fail("string-contains-nul", start)
    _align(c)
    c.short = "payload-truncated"
    return text


def decode(file: File, data: bytes, type_hash: bytes = TYPE_HASH) -> dict:
    """The settings of a decoded file, whose type must have the one supported hash."""
    if file.header["version"] != ENGINE:
        raise Reject("unsupported-engine-version")
    found = [o for o in file.objects if file.types[o["type_ordinal"]]["class_id"] == CLASS]
    if len(found) != 1:
        raise Reject("build-settings-duplicate" if found else "build-settings-missing")
    o = found[0]
    t = file.types[o["type_ordinal"]]
    if not o["byte_size"]:
        raise Reject("object-range-invalid", "object", o["ordinal"])
    if t["stripped_raw"] or t["script_index"] != -1 or any(t["script_hash"] or b"") or t["type_hash"] != type_hash:
        raise Reject("type-identity-unsupported", "type", o["type_ordinal"])
    start = file.header["data_offset"] + o["rel_offset"]
    payload = data[start: start + o["byte_size"]]
    c = Cursor(payload, big=bool(file.header["endian"]), short="payload-truncated")
    out = {"path_id": o["path_id"], "target": file.header["target"]}
    for name in ("scene_count", "preloaded_plugin_count", "enabled_vr_device_count", "build_tag_count"):
        c.field, at = name, c.at
        n = c.i32()
        if not 0 <= n <= c.left // 4:
            raise c.fail("count-invalid", at)
        for _ in range(n):
            _string(c)
        out[name] = n
    c.field = "build_guid"
    out["build_guid"] = c.take(16)
    for name in FLAGS:
        c.field, at = name, c.at
        value = c.u8()
        if value > 1:
            raise c.fail("boolean-invalid", at)
        out[name] = bool(value)
    _align(c)
    c.field = "version"
    out["version"] = _string(c)
    if out["version"] != file.header["version"]:
        raise c.fail("version-mismatch")
    c.field, at = "graphics_apis", c.at
    n = c.i32()
    if not 0 <= n <= c.left // 4:
        raise c.fail("count-invalid", at)
    out["graphics_apis"] = [c.i32() for _ in range(n)]
    _align(c)
    if c.left:
        raise c.fail("object-bytes-not-exhausted")
    return out
