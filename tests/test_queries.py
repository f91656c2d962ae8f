"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from libralake.plans.catalogue import ORACLE_SQL, QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    return float(v) if hasattr(v, "as_tuple") else v


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in records), key=lambda r: [(x is not None, str(type(x)) if isinstance(x, str) else "", x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(got, df.columns) == rows(cur.fetchall(), columns)
