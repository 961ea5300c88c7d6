"""The manual checklist of the original application, as one scripted run
over stored, versioned tables (each step reads the current version and
writes the next)."""

import datetime as dt
import json
import os

from crewgate.operators import companies, flags, reports, workers
from crewgate.schema import COMPANIES, ROLES, WORKERS
from crewgate.sources import tables
from fixtures import company_row, worker_row
from test_changes import CAND, EDITS, WCAND


def test_site_office_checklist(spark, scratch):
    db = os.path.join(scratch, "db")
    tables.write_snapshot(spark.createDataFrame([company_row(1, "Acme", "IT1")], COMPANIES),
                          db, "companies", 0)
    tables.write_snapshot(spark.createDataFrame([worker_row(1, "Ann", "Lee", 1)], WORKERS),
                          db, "workers", 0)
    R = spark.createDataFrame([(1, "FOREMAN")], ROLES)

    last = {"companies": 0, "workers": 0}

    def save(df, name):
        """Write ``df`` as the table's next version."""
        tables.write_snapshot(df, db, name, last[name] + 1)
        last[name] += 1

    def C():
        return tables.read_table(spark, db, "companies", last["companies"])

    def W():
        return tables.read_table(spark, db, "workers", last["workers"])

    # company insert (and the duplicate refused)
    cand = spark.createDataFrame([(1, "Beta Srl", "IT2", "Bo", "b@x.org", "1", ""),
                                  (2, "ACME", "", None, None, None, None)], CAND)
    new_c, out = companies.add_companies(cand, C())
    assert {r["seq"]: r["outcome"] for r in out.collect()} == {1: "accepted", 2: "exists"}
    save(new_c, "companies")
    beta = C().where("company_name = 'Beta Srl'").first()["company_id"]

    # worker insert under the newly added company
    wc = spark.createDataFrame([(1, "Cy", "Doe", "beta srl", "on", "T1", "1", "2024-05-31", "")],
                               WCAND)
    new_w, out = workers.add_workers(wc, W(), C())
    assert out.first()["outcome"] == "accepted"
    save(new_w, "workers")
    cy = W().where("given_name = 'Cy'").first()
    assert cy["company_id"] == beta and cy["expiry_date"] == dt.date(2024, 5, 31)

    # company edit
    ce = spark.createDataFrame([(1, beta, "Beta SpA", "IT2", "Bo", "b@x.org", "1", "")],
                               "seq long, company_id long, company_name string, vat_number string, "
                               "contact_name string, contact_email string, contact_phone string, "
                               "note string")
    save(companies.edit_companies(ce, C())[0], "companies")

    # flags changed from the list, then a worker edit keeps them
    ch = spark.createDataFrame([
        (1, "boss", json.dumps({"type": "worker", "id": cy["worker_id"], "field": "badge_valid",
                                "clicked": "1"})),
        (2, "boss", json.dumps({"type": "worker", "id": cy["worker_id"],
                                "field": "badge_issued", "clicked": "1"}))],
        "seq long, actor string, change string")
    new_w, new_c, _ = flags.apply_flag_changes(ch, W(), C(), ["boss"])
    save(new_w, "workers")
    ed = spark.createDataFrame([(1, cy["worker_id"], "Cyril", "Doe", beta, "1", "on", "T9",
                                 "2024-06-15", "0", "edited")], EDITS)
    save(workers.edit_workers(ed, W(), C(), R)[0], "workers")
    cyril = W().where(f"worker_id = {cy['worker_id']}").first()
    assert (cyril["given_name"], cyril["badge_valid"], cyril["badge_issued"]) == ("Cyril", 1, 1)

    # the weekly report shows the expiry date right and the edited names
    rows = reports.weekly_valid(W(), C(), R).collect()
    assert [(r["company_name"], r["given_name"], r["expiry_text"], r["section"]) for r in rows] \
        == [("Beta SpA", "Cyril", "15/06/2024", "temporary"), ("Acme", "Ann", "", "permanent")]
    assert reports.expired(W(), C(), dt.date(2024, 6, 30)).count() == 1

    # company delete takes its workers along
    ids = spark.createDataFrame([(1, beta)], "seq long, id long")
    new_c, new_w, _ = companies.delete_companies(ids, C(), W())
    save(new_c, "companies")
    save(new_w, "workers")
    assert [r["worker_id"] for r in W().collect()] == [1]
    assert C().count() == 1
