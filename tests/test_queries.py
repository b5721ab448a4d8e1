"""Every registered query next to its SQL counterpart, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert problem is None, problem


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r.task for r in rows} == {"base", "src", "rev", "alpha", "length"}
