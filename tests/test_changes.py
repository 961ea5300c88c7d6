import datetime as dt

from pyspark.sql import functions as F

from crewgate.operators import companies, keys, renames, upsert, workers
from crewgate.schema import COMPANIES, ROLES, WORKERS
from fixtures import company_row, worker_row

CAND = ("seq long, company_name string, vat_number string, contact_name string, "
        "contact_email string, contact_phone string, note string")


def test_add_companies_rules(spark):
    C = spark.createDataFrame([company_row(10, "Acme SpA", " IT100 "), company_row(11, "Old", "")],
                              COMPANIES)
    cand = spark.createDataFrame([
        (1, "ACME  spa", "IT9", None, None, None, None),     # name key of a stored one
        (2, "New One", "\tIT100 ", None, None, None, None),  # VAT of a stored one
        (3, "Zeta", "", None, None, None, None),             # blank VAT never matches
        (4, "zeta", "IT5", None, None, None, None),          # same name as accepted 3
        (5, "Kappa", "IT5", None, None, None, None),         # VAT of rejected 4: accepted
        (6, "Omega", "IT5", None, None, None, None),         # VAT of accepted 5
        (7, "Old", "", None, None, None, None),              # stored name, blank VAT
    ], CAND)
    new_c, out = companies.add_companies(cand, C)
    got = {r["seq"]: (r["outcome"], r["company_id"]) for r in out.collect()}
    assert got == {1: ("exists", None), 2: ("exists", None), 3: ("accepted", 12),
                   4: ("duplicate", None), 5: ("accepted", 13), 6: ("duplicate", None),
                   7: ("exists", None)}
    row = new_c.where("company_id = 12").first()
    assert row["vat_number"] == "" and row["is_sole_trader"] == 0 and row["note"] == ""
    assert new_c.count() == 4


WCAND = ("seq long, given_name string, surname string, company_name string, "
         "is_temporary string, badge_number string, role_id string, expiry_date string, "
         "note string")


def test_add_workers_reason_order_and_batch_rule(spark):
    C = spark.createDataFrame([company_row(1, "Acme"), company_row(2, "Beta")], COMPANIES)
    W = spark.createDataFrame([worker_row(50, "Ann", "Lee", 1)], WORKERS)
    cand = spark.createDataFrame([
        (1, "A", "B", "", None, "", "x", "bad", None),            # no company first
        (2, "A", "B", "acme", None, "", "x", "bad", None),        # then bad role
        (3, "A", "B", "acme", None, "", "", "2024-02-30", None),  # then bad date
        (4, "A", "B", "Nope", None, "", "", "", None),            # company unknown
        (5, "ann", "LEE", "ACME", None, "", "", "", None),        # stored duplicate
        (6, "Tom", "Ray", "Beta", "on", "T9", "", "", None),      # temp without date
        (7, "tom", "ray", "beta", None, "T7", "2", "2024-05-01", "n"),  # accepted (6 did not)
        (8, "TOM", "RAY", "Beta", "on", "", "", "", None),        # duplicate of 7 first
        (9, None, "Ray", "Beta", None, "", "", "", None),         # NULL name: no dup check
        (10, None, "Ray", "Beta", None, "", "", "", None),
        (11, "Sue", "Kim", "Beta", "on", "TB1", "", "2024-1-5", None),
    ], WCAND)
    new_w, out = workers.add_workers(cand, W, C)
    got = {r["seq"]: r["outcome"] for r in out.collect()}
    assert got == {1: "no_company", 2: "bad_role", 3: "bad_date", 4: "company_unknown",
                   5: "duplicate", 6: "temporary_without_date", 7: "accepted",
                   8: "duplicate", 9: "accepted", 10: "accepted", 11: "accepted"}
    ids = {r["seq"]: r["worker_id"] for r in out.where("outcome = 'accepted'").collect()}
    assert ids == {7: 51, 9: 52, 10: 53, 11: 54}
    r7 = new_w.where("worker_id = 51").first()
    assert (r7["role_id"], r7["badge_number"], r7["is_temporary"], r7["badge_valid"]) == \
        (2, "", 0, 0)
    r11 = new_w.where("worker_id = 54").first()
    assert (r11["badge_number"], r11["expiry_date"]) == ("TB1", dt.date(2024, 1, 5))


EDITS = ("seq long, worker_id long, given_name string, surname string, company_id long, "
         "role_id string, is_temporary string, badge_number string, expiry_date string, "
         "clear_date_flag string, note string")


def test_edit_workers(spark):
    W = spark.createDataFrame([
        worker_row(1, "Ann", "Lee", 1, 1, badge_issued=1, expiry_date=dt.date(2024, 1, 1),
                   record_updated=1, badge_valid=1, badge_cancelled=1),
        worker_row(2, "Bob", "Ray", 1)], WORKERS)
    C = spark.createDataFrame([company_row(1, "Acme"), company_row(2, "Beta")], COMPANIES)
    R = spark.createDataFrame([(1, "FOREMAN")], ROLES)
    edits = spark.createDataFrame([
        (1, 1, "A1", "L1", 2, "", None, "X", "2025-01-01", "0", "first"),
        (3, 1, "A3", "L3", 2, "1", "on", "TB", "2025-03-03", "1", "cleared"),  # temp, cleared
        (2, 1, "A2", "L2", 2, "1", "on", "TB", "2025-02-02", "1", "c"),   # temp, no date
        (4, 1, "A4", "L4", 2, "", None, "X", "2025-04-04", "1", "last"),  # clear wins
        (5, 9, "Z", "Z", 1, "", None, "", "", "0", None),                  # not found
        (6, 2, "B", "R", 1, "q", None, "", "", "0", None),                 # bad role first
        (7, 2, "B", "R", 1, "", None, "", "2025-13-01", "0", None),        # bad date
        (8, 2, "B", "R", 5, "", None, "", "", "0", None),                  # company unknown
        (9, 2, "B", "R", 1, "7", None, "", "", "0", None),                 # role unknown
    ], EDITS)
    new_w, out = workers.edit_workers(edits, W, C, R)
    got = {r["seq"]: r["outcome"] for r in out.collect()}
    assert got == {1: "applied", 2: "temporary_without_date", 3: "temporary_without_date",
                   4: "applied", 5: "not_found", 6: "bad_role", 7: "bad_date",
                   8: "company_unknown", 9: "role_unknown"}
    r1 = new_w.where("worker_id = 1").first()
    assert (r1["given_name"], r1["company_id"], r1["role_id"], r1["expiry_date"],
            r1["note"], r1["badge_number"]) == ("A4", 2, None, None, "last", "")
    # the four status flags are kept
    assert (r1["badge_issued"], r1["record_updated"], r1["badge_valid"],
            r1["badge_cancelled"]) == (1, 1, 1, 1)
    assert new_w.where("worker_id = 2").first()["given_name"] == "Bob"


def test_edit_companies_last_wins_flag_kept(spark):
    C = spark.createDataFrame([company_row(1, "Acme", "IT1", sole=1)], COMPANIES)
    edits = spark.createDataFrame([
        (2, 1, "Acme B", "IT2", "c", "e", "p", "n"), (1, 1, "Acme A", "IT1", "c", "e", "p", "n"),
        (3, 5, "Ghost", "", "", "", "", "")],
        "seq long, company_id long, company_name string, vat_number string, "
        "contact_name string, contact_email string, contact_phone string, note string")
    new_c, out = companies.edit_companies(edits, C)
    r = new_c.first()
    assert (r["company_name"], r["vat_number"], r["is_sole_trader"]) == ("Acme B", "IT2", 1)
    assert {x["seq"]: x["outcome"] for x in out.collect()} == \
        {1: "applied", 2: "applied", 3: "not_found"}


def test_deletes_cascade_and_set_null(spark):
    W = spark.createDataFrame([worker_row(1, company_id=1, role_id=1),
                               worker_row(2, company_id=2, role_id=2),
                               worker_row(3, company_id=2, role_id=None)], WORKERS)
    C = spark.createDataFrame([company_row(1, "A"), company_row(2, "B")], COMPANIES)
    R = spark.createDataFrame([(1, "X"), (2, "Y")], ROLES)
    ids = spark.createDataFrame([(5, 2), (4, 2), (6, 9), (7, None)], "seq long, id long")
    told = {4: "deleted", 5: "not_found", 6: "not_found", 7: "not_found"}
    outcomes = lambda df: {r["seq"]: r["outcome"] for r in df.collect()}
    new_c, new_w, out = companies.delete_companies(ids, C, W)
    assert outcomes(out) == told
    assert [r[0] for r in new_c.select("company_id").collect()] == [1]
    assert [r[0] for r in new_w.select("worker_id").collect()] == [1]
    new_r, w2, out = workers.delete_roles(ids, R, W)
    assert outcomes(out) == told
    assert sorted((r["worker_id"], r["role_id"]) for r in w2.collect()) == \
        [(1, 1), (2, None), (3, None)]
    assert new_r.count() == 1
    left, out = workers.delete_workers(ids, W)
    assert left.count() == 2 and outcomes(out) == told
    m = spark.createDataFrame([(1, 2, 20)], "seq long, old_id long, new_id long")
    p, c, out = renames.remap_keys(m, C, W, "company_id", "company_id")
    assert outcomes(out) == {1: "applied"}
    assert sorted(r[0] for r in p.select("company_id").collect()) == [1, 20]
    assert sorted(r[0] for r in c.select("company_id").collect()) == [1, 20, 20]


def test_upsert(spark):
    t0 = dt.datetime(2024, 1, 1)
    now = dt.datetime(2024, 6, 1, 12)
    target = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:00:00")],
                                   "k long, v string, ts string").select(
        "k", "v", F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.col("ts").cast("timestamp_ntz").alias("updated_at"))
    upd = spark.createDataFrame([(5, 1, "a2"), (4, 1, "a1"), (6, 3, "c")],
                                "seq long, k long, v string")
    got = {r["k"]: (r["v"], r["created_at"], r["updated_at"])
           for r in upsert.upsert(upd, target, "k", now).collect()}
    assert got == {1: ("a2", t0, now), 2: ("b", t0, t0), 3: ("c", now, now)}


def test_assign_ids_dense_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("seq"))
    got = keys.assign_ids(df, ["seq"], 100, "nid", num_partitions=7)
    rows = sorted((r["seq"], r["nid"]) for r in got.collect())
    assert [n for _, n in rows] == list(range(100, 5100))


def test_upsert_outcomes(spark):
    target = spark.createDataFrame([(1, "a")], "k long, v string")
    asked = spark.createDataFrame([(5, 1, "x"), (7, 3, "y"), (6, 3, "z"), (8, None, "n")],
                                  "seq long, k long, v string")
    got = {r.seq: r.outcome for r in upsert.upsert_outcomes(asked, target, "k").collect()}
    assert got == {5: "updated", 6: "inserted", 7: "updated", 8: "missing_key"}
