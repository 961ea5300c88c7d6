import datetime as dt

from pyspark.sql import functions as F

from crewgate.operators import reports
from crewgate.schema import COMPANIES, ROLES, WORKERS
from fixtures import AS_OF, company_row, flag_product, worker_row


def ids(df):
    return sorted(r["worker_id"] for r in df.select("worker_id").collect())


def test_weekly_membership_by_rule(spark):
    W, C, R, rows = flag_product(spark)
    want = sorted(r[0] for r in rows if r[8] == 1 and r[10] == 0)
    assert ids(reports.weekly_valid(W, C, R)) == want
    want_zero = sorted(r[0] for r in rows if r[8] == 1 and (r[10] or 0) == 0)
    assert ids(reports.weekly_valid(W, C, R, null_flag_as_zero=True)) == want_zero


def test_expired_membership_by_rule(spark):
    W, C, R, rows = flag_product(spark)
    want = sorted(r[0] for r in rows
                  if r[6] is not None and r[6] <= AS_OF and r[5] == 1 and r[10] == 0
                  and r[8] == 1)
    got = reports.expired(W, C, AS_OF)
    assert ids(got) == want
    # temporary first, NULL temporary is permanent
    secs = [r["section"] for r in got.collect()]
    assert secs == sorted(secs, key=lambda s: s != "temporary")
    counts = {r["section"]: r["n"] for r in reports.section_counts(got).collect()}
    temp = sum(1 for r in rows if r[0] in want and r[11] == 1)
    assert counts == {"temporary": temp, "permanent": len(want) - temp, "total": len(want)}


def test_section_counts_keep_zero_rows(spark):
    empty = spark.createDataFrame([], "section string")
    got = {r["section"]: r["n"] for r in reports.section_counts(empty).collect()}
    assert got == {"temporary": 0, "permanent": 0, "total": 0}


def small_roster(spark):
    W = spark.createDataFrame([
        worker_row(1, "ann", "Zed", 1, 1, expiry_date=dt.date(2024, 1, 2), is_temporary=1),
        worker_row(2, "Bob", "adams", 2, None),
        worker_row(3, "Cy", "Brown", 1, 9, badge_valid=0),
        worker_row(4, "Di", "Carr", 3, None, badge_cancelled=1),
        worker_row(5, "Ed", "Doe", 99, None),
    ], WORKERS)
    C = spark.createDataFrame([company_row(1, "beta"), company_row(2, "Alpha"),
                               company_row(3, "")], COMPANIES)
    R = spark.createDataFrame([(1, "FOREMAN")], ROLES)
    return W, C, R


def test_full_roster_marks_and_join_kinds(spark):
    W, C, R = small_roster(spark)
    rows = reports.full_roster(W, C, R).collect()
    # worker 5 has no company: the inner join drops it; role 9 is unknown
    assert [r["worker_id"] for r in rows] == [4, 2, 1, 3]
    by = {r["worker_id"]: r for r in rows}
    assert by[1]["role_name"] == "FOREMAN" and by[3]["role_name"] == ""
    assert by[3]["valid_mark"] == "" and by[1]["issued_mark"] == "X"
    assert by[1]["expiry_text"] == "02/01/2024" and by[2]["expiry_text"] == ""


def test_weekly_sort_and_totals(spark):
    W, C, R = small_roster(spark)
    wk = reports.weekly_valid(W, C, R)
    assert [r["worker_id"] for r in wk.collect()] == [1, 2]
    t = reports.roster_totals(wk).first()
    assert (t["n_companies"], t["n_workers"]) == (2, 2)


def test_report_lines_layout(spark):
    W, C, R = small_roster(spark)
    lines = reports.report_lines(reports.weekly_valid(W, C, R), reports.WEEKLY, AS_OF).orderBy("line_no")
    got = [(r["line_no"], r["kind"], r["c0"]) for r in lines.collect()]
    assert got == [(0, "title", "Active badges by company, state of 30-06-2024"),
                   (1, "header", "COMPANY"),
                   (2, "section", "Short-term holders"), (3, "data", "beta"),
                   (4, "section", "Regular holders"), (5, "data", "Alpha"),
                   (8, "total", "2 companies listed"), (9, "total", "2 badge holders listed")]
    ex = reports.report_lines(reports.expired(W, C, dt.date(2024, 12, 31)), reports.EXPIRED,
                              dt.date(2024, 12, 31)).orderBy("line_no").collect()
    assert [(r["line_no"], r["kind"]) for r in ex] == [
        (0, "title"), (1, "header"), (2, "section"), (3, "data"), (5, "total"), (6, "total"),
        (7, "total")]
    full = reports.report_lines(reports.full_roster(W, C, R), reports.FULL, AS_OF)
    assert [(r["line_no"], r["c0"]) for r in full.where("kind = 'data'").orderBy("line_no")
            .collect()] == [(k + 2, r["company_name"])
                            for k, r in enumerate(reports.full_roster(W, C, R).collect())]


def test_text_widths(spark):
    df = spark.createDataFrame([("abcdefghijkl", None, "2024")], "a string, b string, c string")
    got = {r["column_index"]: r["width"] for r in
           reports.text_widths(df, ["a", "b", "c"], ["AB", "NAME", "LONGHEADER"], pad=5,
                               cap=10).collect()}
    assert got == {0: 15, 1: 9, 2: 15}
    fixed = {r["column_index"]: r["width"] for r in
             reports.text_widths(df, ["a", "b"], ["AB", "NAME"], pad=10, fixed=(1,)).collect()}
    assert fixed == {0: 22, 1: 4}


def test_digest_rows_and_fallback(spark):
    W, C, R = small_roster(spark)
    ex = reports.expired(W, C, dt.date(2024, 12, 31))
    rec = spark.createDataFrame([("weekly", "a@x.org")], "list_name string, email string")
    rows = reports.digest(ex, rec, dt.date(2024, 12, 31), default="office@x.org").collect()
    assert len(rows) == 1 and rows[0]["recipient"] == "office@x.org"
    assert rows[0]["n_total"] == 1 and "31/12/2024" in rows[0]["subject"]
    none = reports.digest(ex.where(F.lit(False)), rec, AS_OF, default="office@x.org")
    assert none.count() == 0
    two = spark.createDataFrame([("expired", "a@x.org"), ("expired", "b@x.org")],
                                "list_name string, email string")
    assert sorted(r["recipient"] for r in
                  reports.digest(ex, two, AS_OF, default="o@x.org").collect()) == \
        ["a@x.org", "b@x.org"]


def test_write_lines_in_order(spark, scratch):
    import glob
    import os
    W, C, R = small_roster(spark)
    lines = reports.report_lines(reports.weekly_valid(W, C, R), reports.WEEKLY, AS_OF)
    out = os.path.join(scratch, "lines")
    reports.write_lines(lines, out)
    seen = []
    for f in sorted(glob.glob(os.path.join(out, "part-*.csv"))):
        with open(f) as fh:
            seen += [int(x.split(";")[0]) for x in fh.read().splitlines()[1:]]
    assert seen == sorted(seen) and len(seen) == lines.count()


def test_digest_when_empty_and_weekly(spark):
    import pytest
    W, C, R = small_roster(spark)
    ex = reports.expired(W, C, dt.date(2000, 1, 1))
    rec = spark.createDataFrame([("expired", "a@x.org"), ("weekly", " w@x.org "),
                                 ("weekly", "  ")], "list_name string, email string")
    none = reports.digest(ex, rec, dt.date(2000, 1, 1), when_empty=True).collect()
    assert len(none) == 1 and none[0]["attachment"] is None and none[0]["n_total"] == 0
    wk = reports.weekly_digest(reports.weekly_valid(W, C, R), rec, AS_OF).collect()
    assert [(r["recipient"], r["n_workers"], r["attachment"]) for r in wk] == \
        [("w@x.org", 2, "active_badges_30_06_2024.csv")]
    with pytest.raises(ValueError):
        reports.weekly_digest(reports.weekly_valid(W, C, R), rec.where("list_name = 'x'"), AS_OF)


def test_recipient_lists(spark):
    rec = spark.createDataFrame([("weekly", " a@x.org "), ("weekly", " "), ("expired", "b@x.org")],
                                "list_name string, email string")
    assert [r["email"] for r in reports.recipients_for(rec, "weekly", drop_blank=True).collect()] \
        == ["a@x.org"]
    assert [r["email"] for r in reports.recipients_for(rec, "other", default="o@x.org").collect()] \
        == ["o@x.org"]
    assert [r["email"] for r in reports.recipients_for(rec, "expired", default="o@x.org")
            .collect()] == ["b@x.org"]
    assert reports.recipients_for(rec, "weekly").count() == 2


def test_null_names_sort_first_and_blank_company_not_counted(spark):
    W = spark.createDataFrame([
        worker_row(1, "Bo", "Zed", 1), worker_row(2, None, None, 1),
        worker_row(3, "Al", "Ray", 2)], WORKERS)
    C = spark.createDataFrame([company_row(1, "Acme"), company_row(2, "")], COMPANIES)
    R = spark.createDataFrame([], ROLES)
    wk = reports.weekly_valid(W, C, R)
    assert [r["worker_id"] for r in wk.collect()] == [3, 2, 1]
    t = reports.roster_totals(wk).first()
    assert (t["n_companies"], t["n_workers"]) == (1, 3)


def test_write_lines_by_section_and_stamps(spark, scratch):
    import glob
    import os
    from crewgate.functions import exprs as X
    W, C, R = small_roster(spark)
    lines = reports.report_lines(reports.weekly_valid(W, C, R), reports.WEEKLY, AS_OF)
    out = os.path.join(scratch, "by_section")
    reports.write_lines(lines, out, by_section=True)
    folders = sorted(os.path.basename(p) for p in glob.glob(os.path.join(out, "section=*")))
    assert "section=permanent" in folders and "section=temporary" in folders
    df = spark.range(1)
    got = df.select(*[X.as_of_stamp(AS_OF, s).alias(s) for s in ("dash", "slash", "file")]).first()
    assert (got["dash"], got["slash"], got["file"]) == ("30-06-2024", "30/06/2024", "30_06_2024")


def test_recipient_lines_concatenate_to_the_sorted_list(spark):
    import random

    rnd = random.Random(1)
    emails = [f"u{rnd.randrange(400)}@example.org" for _ in range(1000)] + ["", None]
    R = spark.createDataFrame([("weekly", e) for e in emails] + [("other", "x@example.org")],
                              "list_name string, email string")
    to = reports.recipients_for(R, "weekly")
    lines = sorted(reports.recipient_lines(to, size=64).collect(), key=lambda r: r.line)
    assert ", ".join(r.recipients for r in lines) == ", ".join(sorted(e or "" for e in emails))
    assert [r.first_recipient for r in lines] == list(range(1, 1003, 64))
    assert {r.n_recipients for r in lines} == {1002} and sum(r.n_in_line for r in lines) == 1002
    empty = reports.recipients_for(R, "none", default="office@example.org")
    assert [(r.line, r.n_recipients, r.recipients) for r in
            reports.recipient_lines(empty).collect()] == [(0, 1, "office@example.org")]
    assert reports.recipient_lines(R.where("false")).count() == 0
