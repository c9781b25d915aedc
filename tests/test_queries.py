"""Every key/value query with SQL against DuckDB, and the others by their rows."""

import os

import pytest

import __spark_entry__ as entry
from kvspark.plans import catalog

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        path = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def canonical(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got.toPandas()) == canonical(want)
    else:
        assert got.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_record_hex_is_the_whole_record(spark):
    import struct

    from kvspark.plans.catalog import QUERIES

    def xxh32_of_12(b):
        h = (0xCAFEBABE + 0x165667B1 + 12) & 0xFFFFFFFF
        for lane in struct.unpack("<3I", b):
            h = (h + lane * 0xC2B2AE3D) & 0xFFFFFFFF
            h = ((h << 17 | h >> 15) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x85EBCA77 & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE3D & 0xFFFFFFFF
        return h ^ h >> 16

    rows = QUERIES["record_hex"](spark, "/root/testdata/sf0.001").collect()
    assert rows
    for r in rows:
        body = struct.pack(">QI", r.key, r.key % 1000)
        want = b"STAR" + struct.pack("<3I", 8, 4, 4) + body + struct.pack("<Id", xxh32_of_12(body), 0.0) + b"\0ENDE"
        assert r.raw == want.hex().upper()
