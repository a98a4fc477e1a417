"""Every registered query with check SQL, against the check engine on the smallest tables."""

import datetime as dt
import decimal
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from kymo import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
CHECKS = catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not mounted")


def norm(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.6f}"
    return x.isoformat() if isinstance(x, (dt.datetime, dt.date)) else str(x)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_check_sql(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    rel = db.sql(CHECKS[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    theirs = list(rel.columns)
    got = sorted(tuple(norm(row[c]) for c in order) for row in df.collect())
    want = sorted(tuple(norm(row[theirs.index(c)]) for c in order) for row in rel.fetchall())
    assert got == want


def test_every_query_reads_the_tables():
    assert len(CHECKS) >= 190
    assert set(CHECKS) <= set(catalog.queries())
