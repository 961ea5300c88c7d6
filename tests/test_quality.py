import datetime as dt

from crewgate.operators import listing, quality
from crewgate.schema import COMPANIES, ROLES, WORKERS
from fixtures import company_row, worker_row
from test_changes import CAND


def test_duplicate_keys_ignore_null(spark):
    C = spark.createDataFrame([company_row(1, "A", "IT1"), company_row(2, "B", " IT1"),
                               company_row(3, "C", ""), company_row(4, "D", ""),
                               company_row(5, "E", None)], COMPANIES)
    from crewgate.functions import exprs as X
    got = [tuple(r) for r in quality.duplicate_keys(
        C, [X.stored_vat_key("vat_number").alias("vat_key")]).collect()]
    assert got == [("IT1", 2)]


def test_conformance_rejects(spark):
    cand = spark.createDataFrame([(1, "x" * 81, "IT1", "c", "e", "p", "n"),
                                  (2, "ok", "V" * 21, "c" * 101, "e", "p", "n"),
                                  (3, "ok", "IT", "c", "e", "p", "n")], CAND)
    got = sorted(tuple(r) for r in quality.conformance_rejects(cand, COMPANIES, "seq").collect())
    assert got == [(1, "company_name", "too_long", 81), (2, "contact_name", "too_long", 101),
                   (2, "vat_number", "too_long", 21)]
    typed = spark.createDataFrame([(1, None, "x"), (2, "r", "5")],
                                  "seq long, role_name string, role_id string")
    got = sorted(tuple(r) for r in quality.conformance_rejects(typed, ROLES, "seq").collect())
    assert got == [(1, "role_id", "bad_type", None), (1, "role_name", "null", None)]


def test_existing_workers_orphans_and_temporary(spark):
    W = spark.createDataFrame([
        worker_row(1, "Ann", "Lee", 1, 1), worker_row(2, "Bob", "Ray", 9, None),
        worker_row(3, "Cy", "Doe", 1, 7, is_temporary=1),
        worker_row(4, None, "Doe", 1, None, is_temporary=1, expiry_date=dt.date(2024, 1, 1))],
        WORKERS)
    C = spark.createDataFrame([company_row(1, "Acme")], COMPANIES)
    R = spark.createDataFrame([(1, "X")], ROLES)
    cand = spark.createDataFrame([(1, "ANN", "lee", 1), (2, "Ann", "Lee", 2), (3, None, "Doe", 1)],
                                 "seq long, given_name string, surname string, company_id long")
    assert [r["seq"] for r in quality.existing_workers(cand, W).collect()] == [1]
    assert sorted(tuple(r) for r in quality.worker_orphans(W, C, R).collect()) == \
        [(2, "company_id", 9), (3, "role_id", 7)]
    assert [r["worker_id"] for r in
            W.where(quality.temporary_without_date("is_temporary", "expiry_date")).collect()] == [3]
    changes = spark.createDataFrame([(1,), (5,), (5,)], "worker_id long")
    assert [r[0] for r in quality.missing_targets(changes, W, "worker_id").collect()] == [5, 5]


def test_detail_views_and_roles(spark):
    W = spark.createDataFrame([
        worker_row(1, "Ann", "Lee", 1, None, is_temporary=None, badge_number=None,
                   expiry_date=dt.date(2024, 1, 1)),
        worker_row(2, "Bob", "Ray", 5, None)], WORKERS)
    C = spark.createDataFrame([company_row(1, "Acme")], COMPANIES)
    ids = spark.createDataFrame([(1,), (1,), (2,), (3,)], "id long")
    got = {r["worker_id"]: r for r in listing.worker_detail(W, C, ids).collect()}
    assert (got[1]["company_name"], got[1]["is_temporary"], got[1]["badge_number"],
            got[1]["has_date"]) == ("Acme", 0, "", 1)
    assert got[2]["company_name"] is None and got[2]["has_date"] == 0 and len(got) == 2
    assert listing.company_detail(C, ids).count() == 1
    R = spark.createDataFrame([(3, "C"), (1, "A")], ROLES)
    assert [r["role_id"] for r in listing.list_roles(R).collect()] == [1, 3]
    assert [r["company_id"] for r in listing.select_by_id(W, ids, "worker_id").collect()] == \
        [1, 5]
