"""Carrying all columns of an input, whatever their names, through an operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def column(name: str) -> Column:
    """The column of exactly that name, which may hold blanks, dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct: inside, no name can clash or need quoting."""
    return F.struct(*(column(c) for c in df.columns))


def parts(df: DataFrame, row: str) -> list[Column]:
    """The columns of ``df`` again from the struct column ``row``."""
    return [F.col(row).getField(c).alias(c) for c in df.columns]


def schema(ddl: str, carried: DataFrame | None = None, name: str = "in_row") -> StructType:
    """A schema from text, and a struct of the columns of ``carried`` at its end."""
    plain = StructType.fromDDL(ddl)
    if carried is None:
        return plain
    return StructType([*plain.fields, StructField(name, carried.schema)])
