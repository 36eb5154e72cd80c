import os

import duckdb
import pytest
from conftest import SF

from quarry.plans import asset_carriers, carriers, packed_carriers  # noqa: F401

TABLES = [f[:-8] for f in os.listdir(SF)]


def normal(value):
    if value is None or value != value:
        return None
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(normal(r[k]) or "" for k in order) for r in found)


@pytest.mark.parametrize("name", list(carriers.QUERIES))
def test_equals_sql(spark, name):
    df = carriers.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(carriers.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_line_item_is_resolved(spark):
    found = carriers.QUERIES["local_references"](spark, SF)
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert found.count() == line.count() and found.select("l_orderkey", "l_linenumber").exceptAll(line.select("l_orderkey", "l_linenumber")).count() == 0


def test_every_part_is_looked_up(spark):
    found = carriers.QUERIES["registry_lookup"](spark, SF)
    assert sorted(r.p_partkey for r in found.collect()) == sorted(r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").collect())
