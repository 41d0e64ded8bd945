import os

import duckdb
import pytest

from weftline.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    names = ", ".join(f'"{c}"' for c in sorted(df.columns))
    expected = oracle.sql(f"select {names} from ({catalog.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in sorted(df.columns))).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
