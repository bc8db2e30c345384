"""Every query with SQL against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from gaugewright.plans import catalogues

DATA = "/root/testdata/sf0.001"
SQL = {n: s for c in catalogues() for n, s in c.sql.items()}
QUERIES = {n: q for c in catalogues() for n, q in c.queries.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        found.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return found


def cell(x):
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    want = tables.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())
    assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
