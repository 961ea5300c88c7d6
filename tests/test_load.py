import datetime as dt
import os

from crewgate.operators import load
from crewgate.schema import COMPANIES, WORKERS
from crewgate.sources import roster_csv
from fixtures import company_row, worker_row

FILE_A = (
    'Company;Name;"Sur\nname";Note;Expiry;Issued;Valid\n'
    'second header;;;;;;\n'
    '** Acme **;\tAnn ;Lee;"a;b";01/02/2024;X;X\n'
    ';;;;;;\n'
    'Beta;Bob\n'
    'ACME;Cy;Doe;"two\nlines";1/2/2024; x ;X;surplus\n'
    ';;;;;;;only surplus\n'
)
FILE_B = (
    'h1\n'
    'h2\n'
    '*Beta*; Di ;Ray;;1-2-2024;;\n'
    'Gamma;Ed;Fox;;31/02/2024;X;\n'
    'Gamma;Flo;Gil;;01/02/24;;\n'
    'Gamma;Gus;Hay;;;;\n'
)


def write(scratch):
    d = os.path.join(scratch, "raw")
    os.makedirs(d)
    for name, text in (("a.csv", FILE_A), ("b.csv", FILE_B)):
        with open(os.path.join(d, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    return d


def test_read_and_clean(spark, scratch):
    raw = roster_csv.read_roster_csv(spark, write(scratch))
    clean = load.clean_roster(raw).orderBy("file", "record")
    got = [(r["company_name"], r["given_name"], r["surname"], r["note"], r["expiry_text"],
            r["issued_mark"], r["valid_mark"]) for r in clean.collect()]
    assert got == [
        ("Acme", "Ann", "Lee", "a;b", "01/02/2024", "X", "X"),
        ("Beta", "Bob", "", "", "", "", ""),
        ("ACME", "Cy", "Doe", "two\nlines", "1/2/2024", "", "X"),
        ("", "", "", "", "", "", ""),
        ("Beta", "Di", "Ray", "", "1-2-2024", "", ""),
        ("Gamma", "Ed", "Fox", "", "31/02/2024", "X", ""),
        ("Gamma", "Flo", "Gil", "", "01/02/24", "", ""),
        ("Gamma", "Gus", "Hay", "", "", "", ""),
    ]


def test_bulk_load(spark, scratch):
    C = spark.createDataFrame([company_row(7, "beta")], COMPANIES)
    W = spark.createDataFrame([worker_row(40)], WORKERS)
    clean = load.clean_roster(roster_csv.read_roster_csv(spark, write(scratch)))
    new_c, new_w, out = load.bulk_load(clean, C, W)
    assert sorted((r["company_id"], r["company_name"]) for r in new_c.collect()) == \
        [(8, ""), (9, "ACME"), (10, "Acme"), (11, "Beta"), (12, "Gamma")]
    rows = {r["given_name"]: r for r in new_w.collect()}
    assert [rows[g]["worker_id"] for g in ("Ann", "Bob", "Cy", "", "Di", "Ed", "Flo", "Gus")] \
        == list(range(41, 49))
    # case-insensitive lookup, lowest id: Acme/ACME -> 9, Beta -> stored 7
    assert rows["Ann"]["company_id"] == 9 and rows["Cy"]["company_id"] == 9
    assert rows["Bob"]["company_id"] == 7 and rows["Di"]["company_id"] == 7
    assert rows["Ann"]["expiry_date"] == dt.date(2024, 2, 1)
    assert rows["Cy"]["expiry_date"] == dt.date(2024, 2, 1)
    assert rows["Di"]["expiry_date"] == dt.date(2024, 2, 1)
    assert rows["Ed"]["expiry_date"] is None and rows["Flo"]["expiry_date"] is None
    assert (rows["Ann"]["badge_issued"], rows["Cy"]["badge_issued"]) == (1, 0)
    assert (rows["Ann"]["record_updated"], rows["Ann"]["badge_cancelled"],
            rows["Ann"]["is_temporary"], rows["Ann"]["role_id"]) == (1, None, None, None)
    got = {r["worker_id"]: (r["outcome"], r["warning"]) for r in out.collect()}
    assert got[rows["Ed"]["worker_id"]] == ("loaded", "unreadable_date")
    assert got[rows["Flo"]["worker_id"]] == ("loaded", "unreadable_date")
    assert got[rows["Gus"]["worker_id"]] == ("loaded", None)
    skip_c, _, _ = load.bulk_load(clean, C, W, skip_existing=True)
    assert "beta" not in [r["company_name"] for r in skip_c.collect()]


def test_clean_csv_round_trip(spark, scratch):
    clean = load.clean_roster(roster_csv.read_roster_csv(spark, write(scratch)))
    out = os.path.join(scratch, "clean")
    roster_csv.write_clean_csv(clean, out)
    back = spark.read.schema("a string, b string, c string, d string, e string, f string, "
                             "g string").option("sep", ";").option("multiLine", "true") \
        .option("escape", '"').csv(out).na.fill("")
    cols = ["company_name", "given_name", "surname", "note", "expiry_text", "issued_mark",
            "valid_mark"]
    assert sorted(tuple(r) for r in back.collect()) == \
        sorted(tuple(r) for r in clean.select(*cols).collect())


def test_each_table_refuses_its_own_over_long_fields(spark, scratch):
    d = os.path.join(scratch, "long")
    os.makedirs(d)
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8") as fh:
        fh.write("h1\nh2\n")
        fh.write("Acme;Ann;Lee;;;;\n")
        fh.write(f"Beta;{'x' * 51};Lee;;31/31/2024;;\n")     # worker refused, company created
        fh.write(f"{'Long' * 30};Bo;Ray;;31/31/2024;;\n")    # company refused, worker loaded
        fh.write(f"{'Long' * 30};{'x' * 51};Ray;;;;\n")      # both refused
    C = spark.createDataFrame([], COMPANIES)
    W = spark.createDataFrame([], WORKERS)
    clean = load.clean_roster(roster_csv.read_roster_csv(spark, d))
    new_c, new_w, out = load.bulk_load(clean, C, W)
    assert sorted(r["company_name"] for r in new_c.collect()) == ["Acme", "Beta"]
    assert [(r["given_name"], r["company_id"]) for r in new_w.orderBy("worker_id").collect()] \
        == [("Ann", 1), ("Bo", None)]
    assert [(r["outcome"], r["warning"]) for r in out.orderBy("record").collect()] == [
        ("loaded", None), ("too_long", "unreadable_date"), ("loaded", "company_too_long"),
        ("too_long", "company_too_long")]
    kept = load.quarantine(clean).orderBy("record").collect()
    assert [(r["company_name"][:4], len(r["given_name"]), r["reason"]) for r in kept] == [
        ("Beta", 51, "too_long"), ("Long", 2, "company_too_long"), ("Long", 51, "too_long")]


def test_text_in_any_field_makes_a_record(spark, scratch):
    d = os.path.join(scratch, "wide")
    os.makedirs(d)
    lines = [";;;;;;", "", "   ", ";;;;;;;;y", ";;;;;;;;;;;z", ';;"";;;;;; ;', ";\u00a0;",
             "Acme;Ann", "Acme;Bo;Ray;;;;;surplus", "Acme;Cy;Fox;;;X;X;a;b;c"]
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8") as fh:
        fh.write("\n".join(["h1", "h2", *lines]) + "\n")
    rows = load.clean_roster(roster_csv.read_roster_csv(spark, d)).orderBy("record").collect()
    assert [(r["company_name"], r["given_name"], r["surname"], r["valid_mark"]) for r in rows] == [
        ("", "", "", ""), ("", "", "", ""), ("Acme", "Ann", "", ""), ("Acme", "Bo", "Ray", ""),
        ("Acme", "Cy", "Fox", "X")]


def test_split_files_drop_headers_only_at_start(spark, scratch):
    d = os.path.join(scratch, "split")
    os.makedirs(d)
    for name in ("a.csv", "b.csv"):
        with open(os.path.join(d, name), "w", encoding="utf-8") as fh:
            fh.write("Company;Name;Surname;Note;Expiry;Issued;Valid\nsecond header;;;;;;\n")
            for i in range(4000):
                fh.write(f"Firm {i % 7};G{i};S{i};note {i};01/02/2024;X;\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        raw = roster_csv.read_roster_csv(spark, d, multi_line=False)
        assert raw.select("file", "block").distinct().count() > 4  # files really split
        rows = raw.select("f1").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    names = sorted(r["f1"] for r in rows)
    assert len(names) == 8000 and names == sorted([f"G{i}" for i in range(4000)] * 2)
