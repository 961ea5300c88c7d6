"""Small literal fixtures (all rows invented)."""

import datetime as dt
import itertools

from crewgate.schema import COMPANIES, ROLES, WORKERS

AS_OF = dt.date(2024, 6, 30)
TRI = (0, 1, None)


def worker_row(worker_id, given="Ann", surname="Lee", company_id=1, role_id=None,
               badge_issued=1, expiry_date=None, record_updated=0, badge_valid=1, note="",
               badge_cancelled=0, is_temporary=0, badge_number=""):
    return (worker_id, given, surname, company_id, role_id, badge_issued, expiry_date,
            record_updated, badge_valid, note, badge_cancelled, is_temporary, badge_number)


def company_row(company_id, name, vat="", sole=0):
    return (company_id, name, vat, None, None, None, None, sole)


def flag_product(spark):
    """The 324 flag/expiry combinations of FIXTURES.md section 5."""
    dates = (AS_OF - dt.timedelta(days=1), AS_OF, AS_OF + dt.timedelta(days=1), None)
    rows = []
    for i, (iss, val, can, tmp, d) in enumerate(itertools.product(TRI, TRI, TRI, TRI, dates)):
        rows.append(worker_row(i + 1, f"G{i}", f"S{i}", 1, None, iss, d, 0, val, "", can, tmp))
    W = spark.createDataFrame(rows, WORKERS)
    C = spark.createDataFrame([company_row(1, "Acme")], COMPANIES)
    R = spark.createDataFrame([], ROLES)
    return W, C, R, rows
