"""Every registered query against DuckDB, or at least its run, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from quillspark.plans import catalog

DATA = os.environ.get("QUILLSPARK_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = rows(catalog.QUERIES[name](spark, DATA).toArrow())
    if name in catalog.ORACLES:
        assert got == rows(duck.sql(catalog.ORACLES[name]).to_arrow_table())


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES
