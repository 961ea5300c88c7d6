"""Bulk load of a raw roster — one job instead of two round trips per row.

read (S2 S3) -> drop blank rows (F9) -> clean fields (P8-P11) -> distinct
company names (A5), inserted without checks unless ``skip_existing`` ->
company id by case-insensitive name, lowest id (J3, N8) -> workers with the
bulk-load defaults (P16).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.functions import exprs as X
from crewgate.operators.keys import assign_ids, next_id
from crewgate.operators.listing import resolve_company
from crewgate.schema import COMPANIES, RAW_ODD, WORKERS, conform
from crewgate.session import ensure_checkpoint_dir


def _field(i: int) -> F.Column:
    return X.strip_ws(F.coalesce(F.col(f"f{i}"), F.lit("")))


def clean_roster(raw: DataFrame) -> DataFrame:
    """F9 + P8-P11: non-blank records as cleaned text fields plus marks.

    A record is blank when no field holds text, whichever its number: the text
    of a record with other than seven fields is tested without separators and
    quotes."""
    blank = reduce(lambda a, b: a & b, [_field(i) == "" for i in range(7)])
    odd = X.strip_ws(F.translate(F.coalesce(F.col(RAW_ODD), F.lit("")), ';"' + X.PY_WHITESPACE, ""))
    return raw.where(~(blank & (odd == ""))).select(
        "file", "block", "record",
        X.clean_company(F.coalesce(F.col("f0"), F.lit(""))).alias("company_name"),
        _field(1).alias("given_name"), _field(2).alias("surname"), _field(3).alias("note"),
        _field(4).alias("expiry_text"),
        F.when(X.x_flag("f5") == 1, F.lit("X")).otherwise(F.lit("")).alias("issued_mark"),
        F.when(X.x_flag("f6") == 1, F.lit("X")).otherwise(F.lit("")).alias("valid_mark"))


# Outcome codes of a load.
LOADED, TOO_LONG, UNREADABLE_DATE, COMPANY_TOO_LONG = (
    "loaded", "too_long", "unreadable_date", "company_too_long")


def _longer(c: str, schema) -> F.Column:
    return F.length(c) > schema[c].metadata["max_length"]


def worker_too_long() -> F.Column:
    """True when a field of the worker row is longer than its column allows."""
    return _longer("given_name", WORKERS) | _longer("surname", WORKERS) | _longer("note", WORKERS)


def company_too_long() -> F.Column:
    return _longer("company_name", COMPANIES)


def quarantine(clean: DataFrame) -> DataFrame:
    """The cleaned fields of every record that is not, or not wholly, loaded:
    one row per record with ``reason`` (too_long, else company_too_long)."""
    return clean.where(worker_too_long() | company_too_long()).withColumn(
        "reason", F.when(worker_too_long(), F.lit(TOO_LONG)).otherwise(F.lit(COMPANY_TOO_LONG)))


def load_companies(clean: DataFrame, C: DataFrame, skip_existing: bool = False) -> DataFrame:
    """The companies of a load alone: distinct names by exact text, over-long ones left
    out, with ids after the largest stored id in name order."""
    names = clean.where(~company_too_long()).select("company_name").distinct()
    if skip_existing:
        names = names.join(C.select("company_name"), "company_name", "left_anti")
    new_c = assign_ids(names, ["company_name"], next_id(C, "company_id"), "company_id")
    return conform(new_c.select(
        "company_id", "company_name",
        *[F.lit(None).cast("string").alias(c) for c in
          ("vat_number", "contact_name", "contact_email", "contact_phone", "note")],
        F.lit(0).alias("is_sole_trader")), COMPANIES)


def bulk_load(clean: DataFrame, C: DataFrame, W: DataFrame, skip_existing: bool = False,
              collation: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (new companies, new workers, outcomes).

    Company names are distinct by exact text and get ids after the largest
    stored id in name order; a worker's company is looked up
    case-insensitively over stored and new companies (lowest id wins).
    Workers get ids after the largest stored id in (file, split, record)
    order, ``record_updated`` = 1, and NULL cancelled/temporary/role.

    Each table refuses what breaks its own limits: a record with an over-long
    name or note is not loaded as a worker (outcome ``too_long``), while its
    company is created; an over-long company name is not created, and its worker
    loads without a company (warning ``company_too_long``).  Every other record
    is ``loaded``; a date text that is neither d/m/Y nor d-m-Y loads as NULL with
    the warning ``unreadable_date``.  ``quarantine`` keeps the fields of refused
    records.
    """
    # the cleaned records feed the names, the rows and the outcomes: clean
    # them once and keep the result in the shared checkpoint folder
    ensure_checkpoint_dir(clean.sparkSession)
    checked = clean.withColumn("_too_long", worker_too_long()).checkpoint(eager=True)
    ok = checked.where(~F.col("_too_long")).drop("_too_long")
    new_c = load_companies(checked, C, skip_existing)
    every_c = C.select("company_id", "company_name").unionByName(
        new_c.select("company_id", "company_name"))
    rows = resolve_company(ok, every_c, collation=collation)
    rows = rows.select(
        "file", "block", "record", "given_name", "surname", "company_id",
        F.lit(None).cast("long").alias("role_id"),
        F.when(F.col("issued_mark") == "X", F.lit(1)).otherwise(F.lit(0)).alias("badge_issued"),
        X.load_date("expiry_text").alias("expiry_date"),
        F.lit(1).alias("record_updated"),
        F.when(F.col("valid_mark") == "X", F.lit(1)).otherwise(F.lit(0)).alias("badge_valid"),
        "note",
        F.lit(None).cast("int").alias("badge_cancelled"),
        F.lit(None).cast("int").alias("is_temporary"),
        F.lit("").alias("badge_number"))
    new_w = assign_ids(rows, ["file", "block", "record"], next_id(W, "worker_id"), "worker_id")
    loaded = new_w.select("file", "block", "record", "worker_id")
    outcomes = checked.select(
        "file", "block", "record", "_too_long",
        F.when(company_too_long(), F.lit(COMPANY_TOO_LONG))
         .when((F.col("expiry_text") != "") & X.load_date("expiry_text").isNull(),
               F.lit(UNREADABLE_DATE)).alias("warning")
    ).join(loaded, ["file", "block", "record"], "left").select(
        "file", "block", "record", "worker_id",
        F.when(F.col("_too_long"), F.lit(TOO_LONG)).otherwise(F.lit(LOADED)).alias("outcome"),
        "warning")
    return new_c, conform(new_w, WORKERS), outcomes
