import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.decode.cursor import Reject
from quarry.functions import binary, paths

GLOBS = [
    ("", "", True), ("", "a", False), ("*", "", True), ("*", "a/b", True), ("?", "", False), ("?", "é", False), ("??", "é", True), ("a*c", "abc", True), ("a*c", "abd", False),
    ("[abc]", "b", True), ("[!abc]", "b", False), ("[^abc]", "d", True), ("[a-c]x", "bx", True), ("[-a]", "-", True), ("[a-]", "-", True), (r"[\]]", "]", True),
    (r"\*", "*", True), (r"\*", "x", False), ("a**b", "ab", True), ("*.[ch]", "x.h", True), ("A", "a", False), ("*a*b*c*", "xxaxxbxxcxx", True), ("*a*b*c*", "cba", False),
]


def test_glob():
    for pattern, text, want in GLOBS:
        assert paths.glob_matches(pattern, text) is want, (pattern, text)
    for bad in ("[", "[]", "[!]", "[a", "a\\", "[z-a]", "[a-c-e]", "[a\\"):
        assert paths.glob_status(bad) == "malformed-pattern", bad
        with pytest.raises(Reject):
            paths.glob_matches(bad, "a")
    assert paths.glob_matches("*a" * 2048, "a" * 4000) and not paths.glob_matches("*a" * 2048 + "b", "a" * 4000)


def test_glob_against_regex():
    draw = random.Random(5)
    for _ in range(3000):
        pattern = "".join(draw.choice(["a", "b", "*", "?", "[ab]", "[!a]"]) for _ in range(draw.randrange(7)))
        text = "".join(draw.choice("abc") for _ in range(draw.randrange(8)))
        regex = "".join({"*": ".*", "?": "."}.get(x, x.replace("[!", "[^")) for x in re.findall(r"\[[^]]*\]|.", pattern))
        assert paths.glob_matches(pattern, text) == bool(re.fullmatch(regex, text, re.S)), (pattern, text)


def test_glob_column(spark):
    rows = spark.createDataFrame([(t,) for t in {t for _, t, _ in GLOBS}] + [(None,)], "t string")
    for pattern, text, want in GLOBS:
        found = {r.t: r.m for r in rows.select("t", paths.glob(F.col("t"), pattern).alias("m")).collect()}
        assert found[text] is want and found[None] is None, (pattern, text)


RELATIVE = [
    (b"", "empty", 0), (b"/a", "empty-component", 0), (b"a//b", "empty-component", 2), (b"a/", "empty-component", 2), (b"./a", "dot-component", 0), (b"a/..", "dot-component", 2),
    (b"a/../b", "dot-component", 2), (b"a\\b", "backslash", 1), (b"a\x1f", "control-character", 1), (b"a/\xc3(", "invalid-utf8", 2), (b"ok/p\xc3\xa9.x", "ok", None), (b"a\\/..", "backslash", 1),
    (b"..a/b", "ok", None), (b"a/\x00", "control-character", 2),
]


def test_relative_paths(spark):
    for raw, status, offset in RELATIVE:
        assert paths.relative_path_problem(raw) == (status, offset), raw
    rows = spark.createDataFrame([(bytearray(raw),) for raw, _, _ in RELATIVE], "p binary")
    found = rows.select("p", paths.relative_path_check(F.col("p")).alias("c")).collect()
    assert {bytes(r.p): (r.c.status, r.c.offset) for r in found} == {raw: (s, o) for raw, s, o in RELATIVE}
    text = spark.createDataFrame([(raw.decode(), s) for raw, s, _ in RELATIVE if s != "invalid-utf8"], "p string, want string")
    assert text.where(paths.relative_path_status(F.col("p")) != F.col("want")).collect() == []


def test_normalize_and_walk():
    for given, want in [("a/./b//c", "a/b/c"), ("a/../..", ".."), ("../a", "../a"), ("/a/../b", "/b"), ("/..", None), ("", None), ("./", "."), ("/", "/"), ("a\\b", "a\\b"), ("x" * 65536, None)]:
        assert paths.normalize(given) == want
    assert paths.contains("a/b", "a") and not paths.contains("ab", "a") and paths.contains("x", ".") and not paths.contains("../x", ".") and not paths.contains("/a", "a")
    assert list(paths.ancestors("r/a/b", "r")) == ["r/a/b", "r/a", "r"] and list(paths.ancestors("q", "r")) == [] and list(paths.ancestors("/a", "/")) == ["/a", "/"]
    assert paths.join("r/a", "../x") == "r/x" and paths.join("r", "/x") is None and paths.parent("a") == "." and paths.parent("/a") == "/"


def test_binary_expressions(spark):
    raw = bytes([0x80, 1, 2, 3, 4, 5, 6, 0xFF, 9])
    rows = spark.createDataFrame([(bytearray(raw),), (bytearray(raw[:3]),)], "b binary")
    b = F.col("b")
    got = rows.select(
        binary.unsigned(b, 0, 8).alias("u8"), binary.unsigned(b, 0, 8, False).alias("l8"), binary.unsigned(b, 0, 2).alias("u2"), binary.signed(b, 0, 4).alias("s4"), binary.signed(b, 0, 8, False).alias("sl8")).collect()
    assert got[0].u8 == int.from_bytes(raw[:8], "big") and got[0].l8 == int.from_bytes(raw[:8], "little") and got[0].u2 == 0x8001
    assert got[0].s4 == int.from_bytes(raw[:4], "big", signed=True) and got[0].sl8 == int.from_bytes(raw[:8], "little", signed=True)
    assert got[1].u8 is None and got[1].u2 == 0x8001
    texts = spark.createDataFrame([(bytearray(x),) for x in (b"ok", b"\xc0\x80", b"\xed\xa0\x80", "é".encode())], "b binary")
    assert [r[0] for r in texts.select(binary.valid_utf8(F.col("b"))).collect()] == [True, False, False, True]
    assert binary.first_invalid_utf8(b"a\xffb") == 1 and binary.first_invalid_utf8(b"a") is None
    folded = spark.createDataFrame([("ÀB",)], "t string").select(binary.ascii_fold(F.col("t"))).first()[0]
    assert folded == "Àb"
