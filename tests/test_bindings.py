"""Every bound query that has checking SQL gives the same rows in both engines."""

import pytest

import __spark_entry__
from bindings import CHECKS, bound
from bindings.compare import checker, compare

FOLDER = "/root/testdata/sf0.001"
QUERIES = bound()


@pytest.fixture(scope="module")
def con():
    return checker(FOLDER)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    result = compare(df, con, CHECKS[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython") if node in plan]
    assert result["columns"], result["names"]
    assert result["same"], result


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
