"""Every registered query against its DuckDB oracle on the smallest test tables.

Same comparison as the driver: column names, row count and the multiset of rows (columns in
name order, floats rounded to 6 places).
"""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from small_tables import SMALL
from tallyframe.sources.binding import TABLES

QUERIES = E.queries()
ORACLE = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _bag(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(got) == len(want)
    assert _bag(got, cols) == _bag(want, ocols)


def test_entry(spark):
    df = E.entry(spark)
    assert "Total" in df.columns and df.count() > 0
