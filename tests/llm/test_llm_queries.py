"""The registered queries over whole tables, against SQL where there is some."""

import os

import duckdb
import pytest

from kvspark.llm.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def canonical(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA)
    key = {"op6_url_filters": "pages", "op7_chat_formatting": "conversations"}.get(name, "documents")
    n = spark.read.parquet(f"{DATA}/{key}.parquet").count()
    if name in SQL:
        c = duckdb.connect()
        path = f"{DATA}/{key}.parquet"
        c.sql(f"CREATE VIEW {key} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        want = c.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got.toPandas()) == canonical(want)
    rows = got.count()
    assert rows >= n if name.startswith(("op1_", "op4_")) else rows == n


def test_ten_operators():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
