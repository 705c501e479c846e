"""Every registered query with SQL against DuckDB, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (not isinstance(v, (str, bytes)) and not hasattr(v, "__len__") and pd.isna(v)):
            return ""
        if not hasattr(v, "as_integer_ratio"):
            return str(v)
        return str(int(v)) if float(v).is_integer() else f"{float(v):.9g}"  # a column with nulls is one of floats on either side

    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
