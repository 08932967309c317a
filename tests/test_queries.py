"""Every query with SQL against DuckDB, as the driver does."""

import datetime
import glob
import os

import duckdb
import pytest

from lintora.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, db, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    assert len(set(columns)) == len(columns)
    want = db.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({registry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(x.isoformat() if isinstance(x, datetime.datetime) else x for x in r) for r in rows), key=str)
    assert plain(rows) == plain(want)
