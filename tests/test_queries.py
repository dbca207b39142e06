"""Every query against its SQL on the smallest tables, and the driver's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from orrery.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return v
    return round(float(v), 6) + 0.0


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    df = catalog.queries()[name](spark, FOLDER)
    want = sql.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_repeats_itself(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    first = rows(df.columns, df.collect())
    assert first == rows(df.columns, catalog.queries()[name](spark, FOLDER).collect()) and first


def test_contract(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) >= 120


def test_column_pruning_reaches_the_scan(spark):
    plan = catalog.queries()["metric_bundle"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_comment" not in plan
