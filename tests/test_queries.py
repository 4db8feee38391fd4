"""Every registered query against its SQL on the smallest tables, and what their plans must not contain."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from caseloom.workload.views import TABLES
from check import rows_of
from conftest import SF

#: the text operators have tests of their own
NAMES = sorted(n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n))
#: Python inside the plan is allowed only where the operator is one of these.
PYTHON = {"s13", "x02", "x07", "x10", "v01", "v04", "l04"}
#: and in these queries.
PYTHON_QUERIES = {"v05_fragment_search_post"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone='UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    assert "BatchEvalPython" not in physical  # never row-at-a-time Python
    if name[:3] not in PYTHON and name not in PYTHON_QUERIES:
        assert "Python" not in physical and "MapIn" not in physical and "ArrowEval" not in physical
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.sql(sql)
    assert sorted(df.columns) == sorted(result.columns)
    assert rows_of(df.columns, got) == rows_of(result.columns, result.fetchall())


def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
