"""Every query of the engine against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidewell.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


def cell(v):
    return None if v is None else format(v, ".12g") if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=lambda r: [(x is not None, x or "") for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS.get(k, k.upper()) for c, k in df.dtypes} == types
