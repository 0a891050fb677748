"""Registered queries against their SQL in DuckDB."""

import math

import duckdb
import pytest

from scopesift.plans import more, registry

QUERIES, ORACLES = registry.QUERIES | more.QUERIES, registry.ORACLES | more.ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(row):
    return tuple(str(x)[:19].replace("T", " ") if hasattr(x, "isoformat") else None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 9) if isinstance(x, float) else str(x) for x in row)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(norm, got), key=repr) == sorted(map(norm, want.fetchall()), key=repr)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).count() >= 0
