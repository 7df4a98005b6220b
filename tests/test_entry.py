import os

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "lineno", "line"]
