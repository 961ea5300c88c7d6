import random

from pyspark.sql import functions as F

from crewgate.operators import asof, request_log
from crewgate.schema import COMPANIES, WORKERS
from tests.fixtures import company_row, worker_row

LOG = ("seq long, op string, id long, company_name string, vat_number string, "
       "contact_name string, contact_email string, contact_phone string, note string, "
       "given_name string, surname string, is_temporary string, badge_number string, "
       "role_id string, expiry_date string")


def row(seq, op, id_=None, name=None, vat=None, given=None, surname=None, temp=None, role="",
        date=""):
    return (seq, op, id_, name, vat, None, None, None, None, given, surname, temp, "B1", role, date)


def one_at_a_time(log, companies, workers):
    """Apply the rows in order; companies: id -> (name, vat), workers: id -> (g, s, company)."""
    companies, workers, out = dict(companies), dict(workers), {}
    next_c, next_w = max(companies, default=0) + 1, max(workers, default=0) + 1
    stored_c, stored_w = set(companies), set(workers)
    fold = lambda t: None if t is None else t.lower()
    nk = lambda t: (t or "").lower().replace(" ", "")
    for r in sorted(log):
        seq, op, id_, name, vat, given, surname, temp, role, date = (
            r[0], r[1], r[2], r[3], r[4], r[9], r[10], r[11], r[13], r[14])
        told, cid, wid = "unknown_op", None, None
        if op == "add_company":
            typed = (vat or "").strip()
            hit = [i for i, (n, v) in companies.items()
                   if nk(n) == nk(name) or typed and (v or "").strip(" ") == typed]
            if any(i in stored_c for i in hit):
                told = "exists"
            elif hit:
                told = "duplicate"
            else:
                told, cid = "accepted", next_c
                companies[next_c] = (name or "", vat or "")
                next_c += 1
        elif op == "delete_company":
            cid, told = id_, "not_found"
            if id_ in stored_c and id_ in companies:
                told = "deleted"
                del companies[id_]
                workers = {i: w for i, w in workers.items() if w[2] != id_}
        elif op == "delete_worker":
            wid, told = id_, "not_found"
            if id_ in stored_w and id_ in workers:
                told = "deleted"
                del workers[id_]
        elif op == "add_worker":
            cid = min((i for i, (n, _) in companies.items()
                       if name is not None and fold(n) == fold(name)), default=None)
            key = (fold(given), fold(surname), cid)
            if name == "":
                told = "no_company"
            elif role == "x":
                told = "bad_role"
            elif date == "2024-02-30":
                told = "bad_date"
            elif cid is None:
                told = "company_unknown"
            elif None not in key and any((fold(g), fold(s), c) == key
                                         for g, s, c in workers.values()):
                told = "duplicate"
            elif temp == "on" and not date:
                told = "temporary_without_date"
            else:
                told, wid = "accepted", next_w
                workers[next_w] = (given, surname, cid)
                next_w += 1
        out[seq] = (op, told, cid, wid)
    return out, companies, workers


def run(spark, log, companies, workers):
    C = spark.createDataFrame([company_row(i, n, v) for i, (n, v) in companies.items()], COMPANIES)
    W = spark.createDataFrame([worker_row(i, g, s, c) for i, (g, s, c) in workers.items()], WORKERS)
    new_c, new_w, out = request_log.apply_log(spark.createDataFrame(log, LOG), W, C)
    return ({r.seq: (r.op, r.outcome, r.company_id, r.worker_id) for r in out.collect()},
            {r.company_id: (r.company_name, r.vat_number) for r in new_c.collect()},
            {r.worker_id: (r.given_name, r.surname, r.company_id) for r in new_w.collect()})


def test_a_company_then_its_workers_and_back(spark):
    companies = {1: ("Acme", "IT1"), 2: ("ACME", "IT2"), 3: ("Beta", "")}
    workers = {1: ("Ann", "Lee", 1), 2: ("Bob", "Ray", 3)}
    log = [row(1, "add_worker", name="Nova", given="A", surname="B"),       # not there yet
           row(2, "add_company", name="Nova", vat="IT9"),
           row(3, "add_worker", name="nova", given="A", surname="B"),
           row(4, "add_worker", name="acme", given="ann", surname="LEE"),   # stored worker
           row(5, "delete_worker", 1),
           row(6, "add_worker", name="acme", given="ann", surname="LEE"),   # free again
           row(7, "delete_company", 1),                                     # and gone with it
           row(8, "add_worker", name="acme", given="ann", surname="LEE"),   # the other Acme
           row(9, "delete_company", 2), row(10, "add_worker", name="Acme", given="Q", surname="R"),
           row(11, "add_company", name="a c m e", vat=" IT1 "),             # name and VAT are free
           row(12, "add_company", name="Acme"), row(13, "delete_worker", 1),
           row(14, "delete_company", 3), row(15, "delete_worker", 2), row(16, "rename", 1)]
    got = run(spark, log, companies, workers)
    assert got == one_at_a_time(log, companies, workers)
    assert [got[0][k][1] for k in range(1, 17)] == [
        "company_unknown", "accepted", "accepted", "duplicate", "deleted", "accepted", "deleted",
        "accepted", "deleted", "company_unknown", "accepted", "duplicate", "not_found", "deleted",
        "not_found", "unknown_op"]


def test_random_logs(spark):
    rnd = random.Random(9)
    names = [f"{'Firm' if k % 2 else 'FIRM'}{' ' if k % 3 else ''}{k // 4}" for k in range(48)]
    pick = lambda: rnd.choice(names)
    vat = lambda: rnd.choice(["", " ", *[f"IT{k}" for k in range(12)], " IT3"])
    companies = {i: (pick(), vat()) for i in rnd.sample(range(1, 60), 25)}
    people = [("Ann", "Lee"), ("ann", "LEE"), ("Bo", "Ray"), (None, "Lee"), ("Cy", "Fox")]
    workers = {i: (*rnd.choice(people), rnd.choice([*companies, None, 99]))
               for i in rnd.sample(range(1, 200), 60)}
    log = []
    for seq in rnd.sample(range(5000), 500):
        op = rnd.choice(["add_company", "add_worker", "add_worker", "delete_company",
                         "delete_worker", None])
        ident = rnd.choice([None, rnd.randrange(70), rnd.randrange(220)])
        given, surname = rnd.choice(people)
        name = rnd.choice([pick(), pick(), pick(), "", None]) if op == "add_worker" else pick()
        log.append(row(seq, op, ident, name, vat(), given, surname,
                       rnd.choice([None, None, "on"]), rnd.choice(["", "", "1", "x"]),
                       rnd.choice(["", "2024-05-01", "2024-05-01", "2024-02-30"])))
    assert run(spark, log, companies, workers) == one_at_a_time(log, companies, workers)


def test_an_empty_log(spark):
    companies, workers = {1: ("Acme", "")}, {1: ("Ann", "Lee", 1)}
    assert run(spark, [], companies, workers) == ({}, companies, workers)


def test_running_max_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("aabbbbbbbbc"), k, rnd.choice([None, rnd.randrange(1000)])) for k in range(800)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {r.o: r.m for r in asof.running_max(df, "k", "o", "v", "m").collect()}
    for k, o, _ in rows:
        assert got[o] == max((v for x, p, v in rows if x == k and p < o and v is not None),
                             default=None)


def test_no_window_over_a_data_key(spark):
    names = spark.createDataFrame([(1, "a"), (2, "a")], "company_id long, name string")
    died = spark.createDataFrame([(1, 5)], "company_id long, c_died long")
    new = spark.createDataFrame([], "seq long, company_id long, name string")
    got = request_log.name_events(names, died, new)
    assert sorted((r.at, r.company_id) for r in got.where(F.col("name") == "a").collect()) == [
        (request_log.FIRST, 1), (5, 2)]
