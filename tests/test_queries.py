"""Every registered query against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from memspark.plans import registry

SF = "/root/testdata/sf0.001"
CHOSEN = sorted(registry.ORACLE_SQL)


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_duckdb(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    cur = oracle.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == want


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
