"""Every registered query against its DuckDB text, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))

import __spark_entry__ as E  # noqa: E402
import oracle_check  # noqa: E402
from crewgate.plans.catalog import QUERIES  # noqa: E402
from crewgate.plans.oracle import ORACLE_SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) == set(ORACLE_SQL)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, name):
    res = oracle_check.compare(spark, SF, [name])
    assert res[name][2] is True, res[name]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["worker_id", "given_name", "surname"]
    got = {r["worker_id"] for r in df.collect()}
    assert got and got == {r["worker_id"] for r in
                           E.queries()["expired_badges"](spark, SF).collect()}
