"""The batch operators against one-request-at-a-time simulations.

Each simulation applies the requests in seq order to a growing state, the
way single requests would arrive; the batch operator must give the same
outcomes and the same final table.
"""

import datetime as dt
import json
import random

from crewgate.operators import flags, workers
from crewgate.schema import COMPANIES, ROLES, WORKERS
from fixtures import company_row, worker_row
from test_changes import EDITS, WCAND


def _iso(text):
    if not text:
        return None, False
    try:
        y, m, d = (int(x) for x in text.split("-"))
        return dt.date(y, m, d), False
    except ValueError:
        return None, True


def _role(text):
    if text in (None, ""):
        return None, False
    try:
        return int(text), False
    except ValueError:
        return None, True


def _low(x):
    return None if x is None else x.lower()


def simulate_add(cands, stored, companies):
    lookup = {}
    for cid, name in sorted(companies):
        lookup.setdefault(name.lower(), cid)
    state = [(_low(g), _low(s), c) for g, s, c in stored]
    out = {}
    for seq, g, s, cname, temp, _badge, role, date, _note in sorted(cands):
        _, bad_role = _role(role)
        d, bad_date = _iso(date)
        cid = lookup.get(cname.lower()) if cname is not None else None
        key = (_low(g), _low(s), cid)
        if cname == "":
            r = "no_company"
        elif bad_role:
            r = "bad_role"
        elif bad_date:
            r = "bad_date"
        elif cid is None:
            r = "company_unknown"
        elif None not in key and key in state:
            r = "duplicate"
        elif temp == "on" and d is None:
            r = "temporary_without_date"
        else:
            r = "accepted"
            state.append(key)
        out[seq] = r
    return out


def test_add_workers_matches_sequential(spark):
    rnd = random.Random(3)
    companies = [(1, "Acme"), (2, "ACME"), (3, "Beta")]
    C = spark.createDataFrame([company_row(i, n) for i, n in companies], COMPANIES)
    stored = [("Ann", "Lee", 1), ("Bob", "Ray", 3)]
    W = spark.createDataFrame([worker_row(10 + i, g, s, c) for i, (g, s, c) in enumerate(stored)],
                              WORKERS)
    for trial in range(3):
        cands = []
        for seq in rnd.sample(range(1000), 120):
            cands.append((seq, rnd.choice(["Ann", "ann", "Bob", "Cy", None]),
                          rnd.choice(["Lee", "LEE", "Ray", "Doe"]),
                          rnd.choice(["acme", "Acme", "beta", "Gamma", "", None]),
                          rnd.choice(["on", None]), "B", rnd.choice(["", "2", "x"]),
                          rnd.choice(["", "2024-01-02", "2024-02-30"]), None))
        _, out = workers.add_workers(spark.createDataFrame(cands, WCAND), W, C)
        got = {r["seq"]: r["outcome"] for r in out.collect()}
        assert got == simulate_add(cands, stored, companies), trial


def simulate_edit(edits, stored, companies, roles):
    state = {w[0]: list(w) for w in stored}
    out = {}
    for seq, wid, g, s, cid, role, temp, badge, date, clear, note in sorted(edits):
        r_id, bad_role = _role(role)
        clearing = clear == "1"
        d, bad_date = (None, False) if clearing else _iso(date)
        t = 1 if temp == "on" else 0
        if bad_role:
            r = "bad_role"
        elif wid not in state:
            r = "not_found"
        elif bad_date:
            r = "bad_date"
        elif t == 1 and d is None:
            r = "temporary_without_date"
        elif cid is not None and cid not in companies:
            r = "company_unknown"
        elif r_id is not None and r_id not in roles:
            r = "role_unknown"
        else:
            r = "applied"
            row = state[wid]
            row[1], row[2], row[3], row[4], row[6], row[9] = g, s, cid, r_id, d, note
            row[11], row[12] = t, (badge if t == 1 else "")
        out[seq] = r
    return out, sorted(tuple(v) for v in state.values())


def test_edit_workers_matches_sequential(spark):
    rnd = random.Random(5)
    stored = [worker_row(i, f"G{i}", f"S{i}", 1, None, expiry_date=dt.date(2024, 1, 1))
              for i in range(1, 9)]
    W = spark.createDataFrame(stored, WORKERS)
    C = spark.createDataFrame([company_row(1, "A"), company_row(2, "B")], COMPANIES)
    R = spark.createDataFrame([(1, "X")], ROLES)
    edits = []
    for seq in rnd.sample(range(1000), 150):
        edits.append((seq, rnd.randint(1, 10), f"g{seq}", f"s{seq}", rnd.choice([1, 2, 3]),
                      rnd.choice(["", "1", "2", "q"]), rnd.choice(["on", None]), f"b{seq}",
                      rnd.choice(["", "2025-05-05", "2025-13-01"]), rnd.choice(["0", "1"]),
                      f"n{seq}"))
    new_w, out = workers.edit_workers(spark.createDataFrame(edits, EDITS), W, C, R)
    want_out, want_rows = simulate_edit(edits, stored, {1, 2}, {1})
    assert {r["seq"]: r["outcome"] for r in out.collect()} == want_out
    assert sorted(tuple(r) for r in new_w.collect()) == want_rows


FLAG_INDEX = {"badge_issued": 5, "record_updated": 7, "badge_valid": 8, "badge_cancelled": 10}


def test_flag_changes_match_sequential(spark):
    rnd = random.Random(9)
    stored = [worker_row(i, badge_issued=0, badge_valid=0) for i in range(1, 6)]
    W = spark.createDataFrame(stored, WORKERS)
    C = spark.createDataFrame([company_row(1, "A", sole=0)], COMPANIES)
    recs, state, sole = [], {w[0]: list(w) for w in stored}, {1: 0}
    for seq in sorted(rnd.sample(range(5000), 300)):
        kind = rnd.choice(["worker", "worker", "company", "truck"])
        field = rnd.choice(list(FLAG_INDEX) + ["is_sole_trader", "colour"])
        obj = {"type": kind, "id": rnd.randint(1, 7), "field": field}
        if rnd.random() < 0.9:
            obj["clicked"] = rnd.choice(["0", "1", "2", "x", None])
        actor = rnd.choice(["boss", "clerk"])
        recs.append((seq, actor, json.dumps(obj)))
        v = obj.get("clicked")
        ok = ("clicked" in obj and v in ("0", "1") and
              ((kind == "worker" and field in FLAG_INDEX and obj["id"] in state) or
               (kind == "company" and field == "is_sole_trader" and obj["id"] in sole)) and
              not (field == "badge_issued" and actor != "boss"))
        if ok and kind == "worker":
            state[obj["id"]][FLAG_INDEX[field]] = int(v)
        elif ok:
            sole[obj["id"]] = int(v)
    ch = spark.createDataFrame(recs, "seq long, actor string, change string")
    # arrival order need not be seq order: shuffle the rows
    ch = ch.orderBy("change")
    new_w, new_c, _ = flags.apply_flag_changes(ch, W, C, ["boss"])
    assert sorted(tuple(r) for r in new_w.collect()) == sorted(tuple(v) for v in state.values())
    assert new_c.first()["is_sole_trader"] == sole[1]
