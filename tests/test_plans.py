import contextlib
import io

import pytest

import __spark_entry__ as E
from crewgate.operators import reports
from crewgate.plans.catalog import QUERIES
from crewgate.sources import tables
from crewgate.sources import testviews as V

SF = "/root/testdata/sf0.001"
# queries whose builder writes files first (their plans are checked too,
# after the write)
BAD_NODES = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_no_python(spark, name):
    text = plan(E.queries()[name](spark, SF))
    for node in BAD_NODES:
        assert node not in text, f"{name}: {node}"


def test_filter_pushdown_and_pruning(spark, scratch):
    text = plan(E.queries()["workers_by_company"](spark, SF))
    assert "EqualTo(o_custkey,7)" in text
    text = plan(E.queries()["expired_badges"](spark, SF))
    assert "o_totalprice" not in text
    # on a stored snapshot the report predicates reach the parquet scan
    tables.write_snapshot(V.workers(spark, SF), scratch, "workers", 0,
                          sort_within=["company_id", "expiry_date"])
    W = tables.read_table(spark, scratch, "workers", 0)
    text = plan(reports.expired(W, V.companies(spark, SF), V.AS_OF))
    assert "LessThanOrEqual(expiry_date,1998-06-30)" in text
    assert "EqualTo(badge_valid,1)" in text and "EqualTo(badge_cancelled,0)" in text
    assert "note" not in text.split("ReadSchema")[1].split("\n")[0]
