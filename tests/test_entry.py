"""Every query runs at the smallest scale and equals its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from scriptorium.plans import queries
from scriptorium.plans.sql import EXAMPLES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    " clicks sales sale_lines clients client_changes vendors items stamps"
).split()
NAMES = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert plain(rows, got.columns) == plain(want.fetchall(), columns)


@pytest.mark.parametrize("name", queries.examples())
def test_example(spark, duck, name):
    got = queries.examples()[name](spark, SF)
    want = duck.execute(EXAMPLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), columns)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
