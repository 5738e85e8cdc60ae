"""Every query that has SQL against DuckDB over the same tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tapewright.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return int(v) if isinstance(v, bool) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    floats = lambda r: [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r]
    assert rows(df.columns, map(floats, got)) == rows(names, map(floats, cursor.fetchall()))


def test_entry_gives_rows(spark):
    assert len(entry.entry(spark).collect()) == 10


def test_every_query_is_named_once():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) <= set(entry.queries())
