"""Empty inputs and fully rejected batches."""

import datetime as dt

from crewgate.operators import companies, greedy, keys, reports, workers
from crewgate.schema import COMPANIES, ROLES, WORKERS
from fixtures import company_row, worker_row
from test_changes import CAND, WCAND


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "seq long, a string, b string")
    assert keys.assign_ids(e, ["seq"], 1, "id").count() == 0
    assert greedy.first_by_keys(e, ["a", "b"], "seq").count() == 0
    assert keys.next_id(spark.createDataFrame([], "x long"), "x") == 1
    C = spark.createDataFrame([company_row(1, "A")], COMPANIES)
    new_c, out = companies.add_companies(spark.createDataFrame([], CAND), C)
    assert (new_c.count(), out.count()) == (1, 0)
    W = spark.createDataFrame([], WORKERS)
    R = spark.createDataFrame([], ROLES)
    assert reports.weekly_valid(W, C, R).count() == 0
    lines = reports.report_lines(reports.weekly_valid(W, C, R), reports.WEEKLY,
                                 dt.date(2024, 1, 1))
    assert [r["kind"] for r in lines.orderBy("line_no").collect()] == \
        ["title", "header", "total", "total"]


def test_fully_rejected_batch(spark):
    C = spark.createDataFrame([company_row(1, "A")], COMPANIES)
    W = spark.createDataFrame([worker_row(1)], WORKERS)
    wc = spark.createDataFrame([(1, "a", "b", "", None, "", "", "", None)], WCAND)
    new_w, out = workers.add_workers(wc, W, C)
    assert new_w.count() == 1
    assert [(r["outcome"], r["worker_id"]) for r in out.collect()] == [("no_company", None)]
