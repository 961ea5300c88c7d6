"""Lookups, filters, listings and sorts.

The worker table is the fact table; companies and roles are dimensions.
Both joins are left to the planner, whose broadcast threshold is the size
check: the static estimate broadcasts a small table, AQE re-plans from
runtime sizes, and its skew-join rule splits a company that holds a large
share of all workers.  No hint forces a broadcast of an unchecked side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.functions import exprs as X
from crewgate.operators.keys import assign_ids
from crewgate.operators.sizing import join_spread, restrict_to

# J1 J2 J4 --------------------------------------------------------------------
def roster(W: DataFrame, C: DataFrame, R: DataFrame | None = None) -> DataFrame:
    """Workers joined to their company (inner) and role (left outer)."""
    out = W.join(C.select("company_id", "company_name"), "company_id", "inner")
    if R is not None:
        # most workers have no role: their rows are spread when the join shuffles
        out = join_spread(out, R.select("role_id", "role_name"), "role_id", "worker_id", "left")
    return out


# F1 -------------------------------------------------------------------------
def select_by_id(df: DataFrame, ids: DataFrame, key: str, ids_key: str = "id") -> DataFrame:
    """Rows of ``df`` whose key is in the id set (left semi join).  The ids are
    de-duplicated first (map-side), so an id repeated many times cannot
    pile up in one task of the join."""
    return df.join(ids.select(F.col(ids_key).alias(key)).distinct(), key, "left_semi")


# R5 F2 F4 F5 F8 O2 P3 P4 -----------------------------------------------------
def list_workers(W: DataFrame, C: DataFrame, R: DataFrame, company_id: int | None = None,
                 surname: str | None = None, cancelled: bool | None = None,
                 collation: str | None = None) -> DataFrame:
    """Worker list with the page's three filters, in dispatch order
    company > surname > cancelled; no filter gives an empty list.  Sorted by
    surname (under ``collation`` when given)."""
    if company_id is not None:
        W = W.where(F.col("company_id") == F.lit(company_id))
    elif surname is not None:
        term = surname.strip()
        if not term:
            raise ValueError("surname search needs a non-blank text")
        W = W.where(F.instr(F.lower("surname"), term.lower()) > 0)
    elif cancelled:
        W = W.where(F.col("badge_cancelled") == 1)
    else:
        W = W.where(F.lit(False))
    out = roster(W, C, R).select(
        "worker_id", "company_name", "given_name", "surname",
        X.blank_if_null("role_name").alias("role_name"),
        X.blank_if_null("note").alias("note"),
        X.display_date("expiry_date").alias("expiry_text"),
        X.blank_if_null("badge_number").alias("badge_number"),
        X.is_set("badge_issued").alias("issued"),
        X.is_set("record_updated").alias("updated"),
        X.is_set("badge_valid").alias("valid"),
        X.is_set("badge_cancelled").alias("cancelled"),
        X.is_set("is_temporary").alias("temporary"),
    )
    return out.orderBy(X.sort_key("surname", collation).asc(), F.col("worker_id").asc())


# R6 F3 F11 O1 O7 -------------------------------------------------------------
def list_companies(C: DataFrame, name: str | None = None,
                   contains: str | None = None, collation: str | None = None) -> DataFrame:
    """All companies, or those with exactly ``name`` (case-insensitive, or
    equal under ``collation``), or whose name contains ``contains``
    (case-insensitive); by name (under ``collation`` when given), then id."""
    if name is not None:
        C = C.where(X.fold("company_name", collation) == X.fold(F.lit(name), collation))
    if contains is not None:
        C = C.where(F.instr(F.lower("company_name"), contains.lower()) > 0)
    return C.select(
        "company_id", "company_name",
        X.blank_if_null("vat_number").alias("vat_number"),
        X.blank_if_null("contact_name").alias("contact_name"),
        X.blank_if_null("contact_email").alias("contact_email"),
        X.blank_if_null("contact_phone").alias("contact_phone"),
        X.blank_if_null("note").alias("note"),
        X.is_set("is_sole_trader").alias("sole_trader"),
    ).orderBy(X.sort_key("company_name", collation).asc(), F.col("company_id").asc())


def company_picker(C: DataFrame, contains: str | None = None,
                   collation: str | None = None) -> DataFrame:
    """(id, name) pairs for a picker, optionally filtered by a contained text;
    by name (under ``collation`` when given)."""
    if contains is not None:
        C = C.where(F.instr(F.lower("company_name"), contains.lower()) > 0)
    return C.select("company_id", "company_name") \
            .orderBy(X.sort_key("company_name", collation).asc(), F.col("company_id").asc())


def positioned(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``position`` (from 0) in the given order, which must be total."""
    return assign_ids(rows, order, 0, "position")


# O3 -------------------------------------------------------------------------
def list_roles(R: DataFrame) -> DataFrame:
    return R.select("role_id", "role_name").orderBy("role_id")


# J3 O6 ----------------------------------------------------------------------
def company_lookup(C: DataFrame, collation: str | None = None) -> DataFrame:
    """One row per case-folded company name: the lowest id holding it.

    Partial aggregation keeps this skew-safe: a name held by many companies
    is reduced map-side before the shuffle.
    """
    return (C.where(F.col("company_name").isNotNull())
             .groupBy(X.fold("company_name", collation).alias("_name_key"))
             .agg(F.min("company_id").alias("company_id")))


def resolve_company(df: DataFrame, C: DataFrame, name_col: str = "company_name",
                    id_col: str = "company_id", collation: str | None = None) -> DataFrame:
    """Add ``id_col``: the id of the company called ``name_col`` (case-
    insensitive, or equal under ``collation``; lowest id on a tie), NULL when
    there is none."""
    keyed = df.withColumn("_name_key", X.fold(name_col, collation))
    # only the companies the batch names are aggregated (semi-join reduction)
    named = restrict_to(C.select("company_id", "company_name",
                                 X.fold("company_name", collation).alias("_name_key")),
                        keyed, ["_name_key"]).drop("_name_key")
    lookup = company_lookup(named, collation).withColumnRenamed("company_id", id_col)
    return keyed.join(lookup, "_name_key", "left").drop("_name_key")


# F1 J4 P5 P21 ----------------------------------------------------------------
def worker_detail(W: DataFrame, C: DataFrame, ids: DataFrame) -> DataFrame:
    """Edit-form view of the requested workers: stored fields with the
    detail defaults (temporary 0, badge number ''), the company's name and
    whether an expiry date is already set."""
    temporary, number = X.detail_defaults("is_temporary", "badge_number")
    picked = select_by_id(W, ids, "worker_id")
    return picked.join(C.select("company_id", "company_name"), "company_id", "left").select(
        "worker_id", "given_name", "surname", "company_id", "company_name",
        "badge_issued", "record_updated", "note", "expiry_date", "badge_valid",
        "badge_cancelled", temporary.alias("is_temporary"), number.alias("badge_number"),
        "role_id", X.has_date("expiry_date").alias("has_date"))


def company_detail(C: DataFrame, ids: DataFrame) -> DataFrame:
    """Edit-form view of the requested companies (six stored text fields)."""
    return select_by_id(C, ids, "company_id").select(
        "company_id", "company_name", "vat_number", "contact_name", "contact_email",
        "contact_phone", "note")
