"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from millrace.plans import catalogue, learning  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SF}/{name}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = sql.execute(catalogue.SQL[name])
    want = rows([c[0] for c in found.description], found.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
