"""Path predicates and normalisation as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.decode.cursor import Reject

MAX_LOCATOR_BYTES = 65_535


def _class_end(pattern: bytes, at: int) -> int:
    """Where the class that opens before ``at`` closes."""
    if pattern[at: at + 1] in (b"!", b"^"):
        at += 1
    while at < len(pattern) and pattern[at] != ord("]"):
        at += 2 if pattern[at] == ord("\\") else 1
    if at >= len(pattern):
        raise Reject("malformed-pattern", "class", None, at)
    return at


def _class_items(body: bytes) -> list[tuple[int, int]]:
    """The byte ranges of a class body; a raw hyphen is itself only at an edge."""
    atoms: list[tuple[int, bool]] = []
    at = 0
    while at < len(body):
        raw = body[at] != ord("\\")
        at += 0 if raw else 1
        atoms.append((body[at], raw and body[at] == ord("-")))
        at += 1
    items, k = [], 0
    while k < len(atoms):
        value, hyphen = atoms[k]
        if hyphen:
            if items and k + 1 < len(atoms):
                raise Reject("malformed-pattern", "class")
            items.append((value, value))
            k += 1
        elif k + 2 < len(atoms) and atoms[k + 1][1]:
            last, bad = atoms[k + 2]
            if bad or last < value:
                raise Reject("malformed-pattern", "range")
            items.append((value, last))
            k += 3
        else:
            items.append((value, value))
            k += 1
    if not items:
        raise Reject("malformed-pattern", "class")
    return items


def glob_parts(pattern: bytes | str) -> list[frozenset[int] | None]:
    """A pattern as byte sets, with None for a run of stars; refuses a malformed one."""
    pattern = pattern.encode() if isinstance(pattern, str) else pattern
    out: list[frozenset[int] | None] = []
    at = 0
    while at < len(pattern):
        c = pattern[at]
        if c == ord("*"):
            if not out or out[-1] is not None:
                out.append(None)
        elif c == ord("?"):
            out.append(frozenset(range(256)))
        elif c == ord("["):
            end = _class_end(pattern, at + 1)
            negated = pattern[at + 1: at + 2] in (b"!", b"^")
            inside = {b for low, high in _class_items(pattern[at + 1 + negated: end]) for b in range(low, high + 1)}
            out.append(frozenset(range(256)) - inside if negated else frozenset(inside))
            at = end
        else:
            if c == ord("\\"):
                at += 1
                if at >= len(pattern):
                    raise Reject("malformed-pattern", "escape", None, at)
            out.append(frozenset((pattern[at],)))
        at += 1
    return out


def glob_status(pattern: bytes | str) -> str:
    try:
        glob_parts(pattern)
    except Reject as refusal:
        return refusal.status
    return "ok"


def glob_matches(pattern: bytes | str, text: bytes | str) -> bool:
    """Whole-text match in time proportional to pattern times text.

    Between stars a segment is placed at the first spot where it fits, which is enough as a
    star takes up whatever lies between.
    """
    parts, text = glob_parts(pattern), text.encode() if isinstance(text, str) else text
    segments: list[list[frozenset[int]]] = [[]]
    for part in parts:
        if part is None:
            segments.append([])
        else:
            segments[-1].append(part)
    fits = lambda seg, at: all(text[at + k] in s for k, s in enumerate(seg))
    head, tail = segments[0], segments[-1]
    if len(segments) == 1:
        return len(head) == len(text) and fits(head, 0)
    if len(head) + len(tail) > len(text) or not fits(head, 0) or not fits(tail, len(text) - len(tail)):
        return False
    at, end = len(head), len(text) - len(tail)
    for seg in segments[1:-1]:
        at = next((k for k in range(at, end - len(seg) + 1) if fits(seg, k)), None)
        if at is None:
            return False
        at += len(seg)
    return at <= end


def glob_regex(pattern: bytes | str) -> str:
    """The pattern for Java's regex engine over text in which a character is a byte."""
    def one(s: frozenset[int]) -> str:
        if len(s) == 256:
            return "."
        return "[" + "".join(f"\\x{b:02x}" for b in sorted(s)) + "]"

    return r"\A(?s:" + "".join(".*" if p is None else one(p) for p in glob_parts(pattern)) + r")\z"


def glob(path: Column, pattern: str) -> Column:
    """Whether a path matches a constant pattern, bytewise and case-sensitively.

    Patterns with up to two stars become one native regex, which can't backtrack badly;
    with more stars the bounded matcher runs in an Arrow batch function.  A malformed
    pattern is refused, never taken literally.
    """
    stars = sum(p is None for p in glob_parts(pattern))
    if stars <= 2:
        return F.decode(path.cast("binary"), "ISO-8859-1").rlike(glob_regex(pattern))

    @F.pandas_udf(T.BooleanType())
    def match(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else glob_matches(pattern, bytes(v)))

    return match(path.cast("binary"))


def relative_path_problem(path: bytes) -> tuple[str, int | None]:
    """The first rule that a relative path breaks, and the byte where; ('ok', None) if none.

    Components are judged when they end, single bytes and UTF-8 sequences as they come.
    """
    if not path:
        return "empty", 0
    try:
        path.decode()
        bad = len(path)
    except UnicodeDecodeError as error:
        bad = error.start
    begin = 0
    for at in range(len(path) + 1):
        if at == len(path) or path[at] == 0x2F:
            part = path[begin:at]
            if not part:
                return "empty-component", begin
            if part in (b".", b".."):
                return "dot-component", begin
            begin = at + 1
        elif path[at] == 0x5C:
            return "backslash", at
        elif path[at] < 0x20:
            return "control-character", at
        elif at == bad:
            return "invalid-utf8", at
    return "ok", None


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("offset", T.LongType())]))
def _relative_path(values: pd.Series) -> pd.DataFrame:
    found = [("invalid-argument", None) if v is None else relative_path_problem(bytes(v)) for v in values]
    return pd.DataFrame({"status": [f[0] for f in found], "offset": pd.array([f[1] for f in found], dtype="Int64")})


def relative_path_check(path: Column) -> Column:
    """``status`` and ``offset`` of the first broken rule."""
    return _relative_path(path.cast("binary"))


def relative_path_status(path: Column) -> Column:
    """Only the status, for valid UTF-8, as one native expression: the earliest problem wins."""
    at = lambda pattern: F.regexp_instr(path, F.lit(pattern))
    # A component's problem shows where it ends, so its end competes with single characters.
    ends = {
        "empty-component": r"(^|/)(?=/|$)", "dot-component": r"(^|/)\.\.?(?=/|$)",
        "backslash": r"\\", "control-character": r"[\x00-\x1f]"}
    first = {}
    for name, pattern in ends.items():
        hit = F.regexp_extract(path, pattern, 0)
        start = at(pattern)
        place = start + F.length(hit) if name.endswith("component") else start
        first[name] = F.when(F.regexp_like(path, F.lit(pattern)), place)
    least = F.least(*first.values())
    status = F.when(F.length(path) == 0, "empty")
    for name, place in first.items():
        status = status.when(place == least, name)
    return status.otherwise("ok")


def is_within(path: Column, root: Column) -> Column:
    """Whether a path equals a root or lies below it, by whole components."""
    return (root != "") & ((path == root) | path.startswith(F.concat(root, F.lit("/"))))


def normalize(path: str | None) -> str | None:
    """Slashes collapsed, ``.`` and ``..`` resolved; a relative path keeps leading ``..``, an
    absolute one that climbs above its root is refused (None), as are empty and over-long ones."""
    if not path or len(path.encode()) > MAX_LOCATOR_BYTES:
        return None
    absolute, out = path.startswith("/"), []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part == ".." and absolute:
            return None
        else:
            out.append(part)
    return "/" + "/".join(out) if absolute else "/".join(out) or "."


@F.pandas_udf(T.StringType())
def normalized(path: pd.Series) -> pd.Series:
    return path.map(normalize)


def contains(path: str, root: str) -> bool:
    """Whether a normalised path is a normalised root or below it."""
    if path.startswith("/") != root.startswith("/"):
        return False
    if path == root:
        return True
    if root == ".":
        return path != ".." and not path.startswith("../")
    return path.startswith(root if root.endswith("/") else root + "/")


def parent(path: str) -> str:
    """The directory of a normalised path; a root is its own."""
    if path == "/":
        return path
    head, slash, _ = path.rpartition("/")
    return head or ("/" if slash else ".")


def join(base: str, relative: str) -> str | None:
    """A relative locator under a normalised directory; None if it is absolute or invalid."""
    inner = normalize(relative)
    if inner is None or inner.startswith("/"):
        return None
    return normalize(inner if base == "." else f"{base.rstrip('/')}/{inner}")


def ancestors(directory: str | None, root: str | None) -> Iterator[str]:
    """A normalised directory and its parents, nearest first, as far as the root."""
    while directory is not None and root is not None and contains(directory, root):
        yield directory
        if directory == root or parent(directory) == directory:
            return
        directory = parent(directory)
