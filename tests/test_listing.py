import pytest

from crewgate.operators import listing
from crewgate.schema import COMPANIES
from fixtures import company_row
from test_reports import small_roster


def test_worker_list_dispatch(spark):
    W, C, R = small_roster(spark)
    assert [r["worker_id"] for r in listing.list_workers(W, C, R, company_id=1).collect()] == \
        [3, 1]
    assert [r["worker_id"] for r in listing.list_workers(W, C, R, surname=" AD").collect()] == \
        [2]
    assert [r["worker_id"] for r in listing.list_workers(W, C, R, cancelled=True).collect()] == \
        [4]
    assert listing.list_workers(W, C, R).count() == 0
    # company filter wins over the others
    assert listing.list_workers(W, C, R, company_id=2, surname="zed").count() == 1
    with pytest.raises(ValueError):
        listing.list_workers(W, C, R, surname="  ")


def test_companies_by_name_and_picker(spark):
    W, C, R = small_roster(spark)
    assert [r["company_id"] for r in listing.list_companies(C, name="ALPHA").collect()] == [2]
    assert [r["company_id"] for r in listing.list_companies(C).collect()] == [3, 2, 1]
    assert [r["company_id"] for r in listing.company_picker(C, contains="ET").collect()] == [1]


def test_resolve_company_lowest_id_case_insensitive(spark):
    C = spark.createDataFrame([company_row(5, "Acme"), company_row(3, "ACME"),
                               company_row(7, "Other")], COMPANIES)
    req = spark.createDataFrame([(1, "acme"), (2, "none"), (3, None)],
                                "seq long, company_name string")
    got = {r["seq"]: r["company_id"] for r in listing.resolve_company(req, C).collect()}
    assert got == {1: 3, 2: None, 3: None}


def test_company_lookup_one_row_per_name(spark):
    C = spark.createDataFrame([company_row(5, "Acme"), company_row(3, "ACME"),
                               company_row(4, None)], COMPANIES)
    assert [tuple(r) for r in listing.company_lookup(C).collect()] == [("acme", 3)]
