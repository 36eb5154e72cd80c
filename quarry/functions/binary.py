"""Integers, text checks and folding over BINARY columns, native but for the place of an error."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def unsigned(data: Column, offset: int, width: int, big: bool = True) -> Column:
    """An unsigned integer of 1 to 8 bytes at a byte offset; null if it isn't all there.

    The digits are joined byte by byte: reverse() of a binary works on characters.
    """
    order = range(width) if big else range(width - 1, -1, -1)
    digits = F.concat(*(F.hex(F.substring(data, offset + 1 + k, 1)) for k in order))
    number = F.conv(digits, 16, 10).cast("decimal(20,0)")
    number = number if width == 8 else number.cast("long")
    return F.when(F.octet_length(data) >= offset + width, number)


def signed(data: Column, offset: int, width: int, big: bool = True) -> Column:
    """The same bytes in two's complement, as LONG."""
    value = unsigned(data, offset, width, big).cast("decimal(20,0)")
    top = F.lit(str(1 << (8 * width - 1))).cast("decimal(20,0)")
    span = F.lit(str(1 << 8 * width)).cast("decimal(20,0)")
    return F.when(value < top, value).otherwise(value - span).cast("long")


def ascii_fold(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike lower()."""
    return F.translate(text, UPPER, LOWER)


def equals_ignoring_ascii_case(a: Column, b: Column) -> Column:
    return ascii_fold(a) == ascii_fold(b)


def valid_utf8(data: Column) -> Column:
    """Strict UTF-8: no surrogates, no overlong forms, nothing above U+10FFFF."""
    return F.is_valid_utf8(data.cast("binary").cast("string"))


def first_invalid_utf8(data: bytes) -> int | None:
    try:
        data.decode("utf-8", "strict")
    except UnicodeDecodeError as error:
        return error.start
    return None


@F.pandas_udf(T.LongType())
def _first_invalid(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else first_invalid_utf8(bytes(v)) for v in values], dtype="Int64")


def utf8_error(data: Column) -> Column:
    """The offset of the first byte sequence that isn't strict UTF-8, null if there is none."""
    return F.when(~valid_utf8(data), _first_invalid(data.cast("binary")))


def digest(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def checked_sum(a: Column, b: Column) -> Column:
    """The sum, or null where it overflows."""
    return F.try_add(a, b)


def checked_product(a: Column, b: Column) -> Column:
    """The product, or null where it overflows."""
    return F.try_multiply(a, b)
