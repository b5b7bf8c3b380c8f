"""Queries of the corpus operators against their SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from tickloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def rows(records):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(plain, r)) for r in records)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = sql.sql(ORACLES[name])
    assert sorted(expected.columns) == columns
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(expected.project(", ".join(columns)).fetchall())
