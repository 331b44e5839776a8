"""Every registered query against its SQL, and what its plan may not contain."""

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from ledgerlake.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER)
    if name != "file_fingerprint":
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in text and "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text
    want = con.sql(ORACLE[name]).to_arrow_table()
    assert want.num_rows > 0
    assert differences(got.toArrow(), want) is None


def test_every_query_is_registered():
    assert QUERIES.items() <= queries().items() and ORACLE.items() <= oracle_sql().items()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).columns == ["year", "color", "total_revenue"]
