"""Every query with SQL, against DuckDB."""

import os

import duckdb
import pytest

from tidelog import catalog

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(PATH):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{PATH}/{f}'")
    return c


def plain(rows):
    return sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, PATH)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, PATH).count() > 0
