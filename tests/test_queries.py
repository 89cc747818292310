"""Every registered query against its SQL statement."""

import re

import pytest

import __spark_entry__ as entry_points
from conftest import SMALL
from helpers import duck_bag, frame_bag

QUERIES = {name: f for name, f in entry_points.queries().items() if name.startswith("q_")}
STATEMENTS = {name: sql for name, sql in entry_points.oracle_sql().items() if name.startswith("q_")}


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_statement(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    expected, columns = duck_bag(duck, STATEMENTS[name])
    assert sorted(df.columns) == columns
    assert frame_bag(df) == expected
    assert expected, "a query without rows checks nothing"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoop|EvalPython|InPandas|PythonUDF", plan)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
