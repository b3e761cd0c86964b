"""Every registered query against its twin in SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from gridloom.queries import ORACLE_SQL, QUERIES
from gridloom.sources.bindings import BASE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in BASE:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, bool) or not isinstance(v, int):
        return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v
    return float(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    assert name in ORACLE_SQL
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=str)
    found = sql.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    assert list(map(str, got)) == sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())
