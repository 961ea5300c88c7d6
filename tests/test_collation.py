"""The optional case- and accent-insensitive collation (as the original
database's default) on name lookups, duplicate checks and company lists."""

from crewgate.operators import companies, listing, workers
from crewgate.schema import COMPANIES, WORKERS
from fixtures import company_row, worker_row
from test_changes import CAND, WCAND

CI_AI = "UNICODE_CI_AI"


def stored(spark):
    C = spark.createDataFrame([company_row(1, "Società  Srl", "IT1"), company_row(2, "Straße")],
                              COMPANIES)
    W = spark.createDataFrame([worker_row(9, "José", "Núñez", 1)], WORKERS)
    return C, W


def test_lookup_and_list(spark):
    C, _ = stored(spark)
    req = spark.createDataFrame([(1, "SOCIETÀ  SRL"), (2, "societa  srl"), (3, "STRASSE")],
                                "seq long, company_name string")
    plain = {r["seq"]: r["company_id"] for r in listing.resolve_company(req, C).collect()}
    ci_ai = {r["seq"]: r["company_id"]
             for r in listing.resolve_company(req, C, collation=CI_AI).collect()}
    assert plain == {1: 1, 2: None, 3: None}
    assert ci_ai == {1: 1, 2: 1, 3: 2}
    assert listing.list_companies(C, name="strasse").count() == 0
    assert listing.list_companies(C, name="strasse", collation=CI_AI).count() == 1


def test_duplicate_rules_follow_the_collation(spark):
    C, W = stored(spark)
    cand = spark.createDataFrame([(1, "SOCIETA SRL", "", None, None, None, None)], CAND)
    _, plain = companies.add_companies(cand, C)
    _, ci_ai = companies.add_companies(cand, C, collation=CI_AI)
    assert plain.first()["outcome"] == "accepted"
    assert ci_ai.first()["outcome"] == "exists"
    wc = spark.createDataFrame([(1, "JOSE", "nunez", "Società  Srl", None, "", "", "", None)],
                               WCAND)
    _, plain = workers.add_workers(wc, W, C)
    _, ci_ai = workers.add_workers(wc, W, C, collation=CI_AI)
    assert plain.first()["outcome"] == "accepted"
    assert ci_ai.first()["outcome"] == "duplicate"


def test_sorts_follow_the_collation(spark):
    import datetime as dt
    from crewgate.operators import reports
    from crewgate.schema import ROLES
    C = spark.createDataFrame([company_row(1, "Zeta"), company_row(2, "eagle"),
                               company_row(3, "Élan")], COMPANIES)
    W = spark.createDataFrame([worker_row(i, "G", "S", i) for i in (1, 2, 3)], WORKERS)
    R = spark.createDataFrame([], ROLES)
    plain = [r["company_name"] for r in reports.full_roster(W, C, R).collect()]
    ci_ai = [r["company_name"] for r in reports.full_roster(W, C, R, collation=CI_AI).collect()]
    assert plain == ["Zeta", "eagle", "Élan"]
    assert ci_ai == ["eagle", "Élan", "Zeta"]
    assert [r["company_name"] for r in
            reports.weekly_valid(W, C, R, collation=CI_AI).collect()] == ci_ai
    lines = reports.report_lines(reports.weekly_valid(W, C, R, collation=CI_AI), reports.WEEKLY,
                                 dt.date(2024, 1, 1), collation=CI_AI)
    assert [r["c0"] for r in lines.where("kind = 'data'").orderBy("line_no").collect()] == ci_ai
    assert [r["company_name"] for r in
            listing.company_picker(C, collation=CI_AI).collect()] == ci_ai
