"""Table schemas of the roster model.

Ids are ``long`` (unsigned 32-bit ids overflow ``int``); flags are nullable
``int`` with three values 0/1/NULL and are never coerced; text lengths are
kept as column metadata (``max_length``) and enforced by
``operators.quality.conformance_rejects``.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _text(name: str, max_length: int | None, nullable: bool = True) -> T.StructField:
    meta = {"max_length": max_length} if max_length else {}
    return T.StructField(name, T.StringType(), nullable, metadata=meta)


def _id(name: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T.LongType(), nullable)


def _flag(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType(), True)


COMPANIES = T.StructType([
    _id("company_id", False),
    _text("company_name", 80),
    _text("vat_number", 20),
    _text("contact_name", 100),
    _text("contact_email", 50),
    _text("contact_phone", 20),
    _text("note", 100),
    _flag("is_sole_trader"),
])

ROLES = T.StructType([
    _id("role_id", False),
    _text("role_name", 50, nullable=False),
])

WORKERS = T.StructType([
    _id("worker_id", False),
    _text("given_name", 50),
    _text("surname", 50),
    _id("company_id"),
    _id("role_id"),
    _flag("badge_issued"),
    T.StructField("expiry_date", T.DateType(), True),
    _flag("record_updated"),
    _flag("badge_valid"),
    _text("note", 100),
    _flag("badge_cancelled"),
    _flag("is_temporary"),
    _text("badge_number", 50),
])

RECIPIENTS = T.StructType([
    _text("list_name", 100, nullable=False),
    _text("email", 100, nullable=False),
])

# Raw roster CSV: seven positional fields, and the text of every record that
# has another number of fields (short ones, and ones with surplus fields).
RAW_ODD = "odd_record"
RAW_ROSTER = T.StructType(
    [T.StructField(f"f{i}", T.StringType(), True) for i in range(7)]
    + [T.StructField(RAW_ODD, T.StringType(), True)])

# Flag fields a change record may set, by entity type.
WORKER_FLAGS = ("record_updated", "badge_issued", "badge_valid", "badge_cancelled")
COMPANY_FLAGS = ("is_sole_trader",)
FLAG_FIELDS = {"worker": WORKER_FLAGS, "company": COMPANY_FLAGS}

TABLES = {"companies": COMPANIES, "roles": ROLES, "workers": WORKERS,
          "recipients": RECIPIENTS}


def conform(df, schema: T.StructType, fill_missing: bool = False):
    """Project ``df`` onto ``schema``: order, names and types.  With
    ``fill_missing`` a column absent from ``df`` becomes NULL."""
    from pyspark.sql import functions as F
    have = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in have or not fill_missing else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in schema.fields])
