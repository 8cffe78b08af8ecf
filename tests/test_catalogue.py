"""Every draw query against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from urnspark import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted((repr(tuple(clean(r[i]) for i in order)) for r in data))


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, df.collect()) == rows(cols, want)


def test_entry(spark):
    assert entry.entry(spark).count() == 49
    assert set(entry.oracle_sql()) <= set(entry.queries())
