"""Column expressions (Column -> Column), all JVM-side built-ins.

Each function is one scalar rule of the roster model; none of them needs a
Python UDF, so every projection stays inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points Python's str.strip() removes (those for
# which str.isspace() is true), in code-point order.
PY_WHITESPACE = ("\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085"
                 "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
                 "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# Display formats of dates.
DISPLAY_DATE = "dd/MM/yyyy"          # cells of reports and lists
STAMP_FORMATS = {"dash": "dd-MM-yyyy", "slash": "dd/MM/yyyy", "file": "dd_MM_yyyy"}

# The field shapes Python's strptime accepts for %d, %m, %Y
# (day 1-31 with an optional leading zero or a leading blank, month 1-12 with
# an optional leading zero, exactly four year digits).
_DAY = r"(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_YEAR = r"([0-9]{4})"
# raw roster CSV: day/month/year, else day-month-year; form input: ISO
LOAD_DATE_SHAPES = (rf"^{_DAY}/{_MONTH}/{_YEAR}$", rf"^{_DAY}-{_MONTH}-{_YEAR}$")
ISO_DATE_SHAPE = rf"^{_YEAR}-{_MONTH}-{_DAY}$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# P2 -------------------------------------------------------------------------
def x_mark(flag) -> Column:
    """Truthy flag -> 'X', else '' (NULL -> '')."""
    return F.when(_c(flag) != 0, F.lit("X")).otherwise(F.lit(""))


# P3 -------------------------------------------------------------------------
def is_set(flag) -> Column:
    """Flag == 1 as boolean; NULL counts as not set."""
    return F.coalesce(_c(flag) == 1, F.lit(False))


# P4 / P14 -------------------------------------------------------------------
def blank_if_null(c) -> Column:
    return F.coalesce(_c(c), F.lit(""))


# P5 -------------------------------------------------------------------------
def detail_defaults(is_temporary, badge_number) -> tuple[Column, Column]:
    return (F.coalesce(_c(is_temporary), F.lit(0)),
            F.coalesce(_c(badge_number), F.lit("")))


# P6 -------------------------------------------------------------------------
def display_date(d) -> Column:
    """DATE -> dd/MM/yyyy; NULL -> ''."""
    return F.coalesce(F.date_format(_c(d), DISPLAY_DATE), F.lit(""))


def display_date_text(s) -> Column:
    """ISO text -> dd/MM/yyyy; unparsable text passes through; NULL -> ''."""
    return F.coalesce(F.date_format(iso_date(s), DISPLAY_DATE), _c(s), F.lit(""))


# P7 -------------------------------------------------------------------------
def as_of_stamp(as_of: dt.date, style: str = "dash") -> Column:
    return F.date_format(F.lit(as_of), STAMP_FORMATS[style])


# P8 -------------------------------------------------------------------------
def strip_ws(c) -> Column:
    """Remove leading and trailing Unicode whitespace (Python ``strip()``):
    ``btrim`` with the set of whitespace code points, no regex."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


# P9 -------------------------------------------------------------------------
def clean_company(c) -> Column:
    """Strip '*', then whitespace, then '*' again."""
    star = F.lit("*")
    return F.btrim(strip_ws(F.btrim(_c(c), star)), star)


# P10 ------------------------------------------------------------------------
def x_flag(c) -> Column:
    """'X' marker (exact, after strip) -> 1, anything else -> 0."""
    return F.when(strip_ws(_c(c)) == "X", F.lit(1)).otherwise(F.lit(0))


def _shaped_date(c: Column, shape: str, y: int, m: int, d: int) -> Column:
    """Date from text of the given regex shape (groups y, m, d), else NULL.
    The fields are rebuilt as yyyy-MM-dd, so impossible dates (31/02) and
    year 0000 give NULL, as with Python's strptime."""
    part = lambda i: F.trim(F.regexp_extract(c, shape, i))
    canonical = F.concat_ws("-", part(y), F.lpad(part(m), 2, "0"), F.lpad(part(d), 2, "0"))
    parsed = F.try_to_date(canonical, "yyyy-MM-dd")
    return F.when(c.rlike(shape) & (F.year(parsed) >= 1), parsed)


# P11 ------------------------------------------------------------------------
def load_date(c) -> Column:
    """d/m/Y, else d-m-Y (Python strptime shapes), else NULL."""
    return F.coalesce(*[_shaped_date(_c(c), s, 3, 2, 1) for s in LOAD_DATE_SHAPES])


# P12 ------------------------------------------------------------------------
def iso_date(c) -> Column:
    """Strict ISO date (Python strptime %Y-%m-%d); NULL when empty or not a
    date (see ``bad_iso_date``)."""
    return _shaped_date(F.nullif(_c(c), F.lit("")), ISO_DATE_SHAPE, 1, 2, 3)


def bad_iso_date(c) -> Column:
    """True when text is given but is not an ISO date."""
    return (F.coalesce(_c(c), F.lit("")) != "") & iso_date(c).isNull()


# P13 ------------------------------------------------------------------------
def empty_as_null(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


def optional_id(c) -> Column:
    """'' or NULL -> NULL; digits -> bigint; anything else -> NULL (see bad_id)."""
    return empty_as_null(c).try_cast("bigint")


def bad_id(c) -> Column:
    return empty_as_null(c).isNotNull() & optional_id(c).isNull()


# P15 ------------------------------------------------------------------------
def badge_number_if_temporary(is_temporary, badge_number) -> Column:
    return F.when(_c(is_temporary) == 1, blank_if_null(badge_number)).otherwise(F.lit(""))


# P17 ------------------------------------------------------------------------
def checkbox(c) -> Column:
    return F.when(_c(c) == "on", F.lit(1)).otherwise(F.lit(0))


# P18 ------------------------------------------------------------------------
def flag_value(c) -> Column:
    """Text -> int 0/1, NULL when not an integer or out of range."""
    v = _c(c).try_cast("int")
    return F.when(v.isin(0, 1), v)


# Collation policy -----------------------------------------------------------
def fold(c, collation: str | None = None) -> Column:
    """Comparison key for case-insensitive equality: ``lower(c)`` by default,
    or ``c`` under a case/accent-insensitive collation such as
    ``UNICODE_CI_AI`` (then also 'Società' = 'SOCIETA' and 'ß' = 'ss'); joins,
    group-by and distinct on the key follow the collation."""
    return F.lower(_c(c)) if collation is None else F.collate(_c(c), collation)


def sort_key(c, collation: str | None = None) -> Column:
    """Sort key of a text column: the text itself (code-point order) by
    default, or the text under ``collation`` (e.g. UNICODE_CI_AI: dictionary
    order, case and accents ignored)."""
    return _c(c) if collation is None else F.collate(_c(c), collation)


# P19 ------------------------------------------------------------------------
def name_key(c, collation: str | None = None) -> Column:
    """Lower case (or the collation's equality), every ASCII blank removed."""
    return F.replace(fold(c, collation), F.lit(" "), F.lit(""))


# P20 ------------------------------------------------------------------------
def stored_vat_key(c) -> Column:
    """Stored side: spaces trimmed (SQL TRIM); blank -> NULL (never matches)."""
    return F.nullif(F.trim(_c(c)), F.lit(""))


def typed_vat_key(c) -> Column:
    """Typed side: all outer whitespace stripped; blank -> NULL."""
    return F.nullif(strip_ws(_c(c)), F.lit(""))


# P21 ------------------------------------------------------------------------
def has_date(c) -> Column:
    return _c(c).isNotNull().cast("int")


# P22 ------------------------------------------------------------------------
def badge_status(as_of: dt.date, cancelled="badge_cancelled", issued="badge_issued",
                 valid="badge_valid", expiry="expiry_date") -> Column:
    """First state that applies, in this order: cancelled, not_issued,
    suspended, expired (on or before ``as_of``), admitted."""
    return (F.when(is_set(cancelled), F.lit("cancelled"))
            .when(~is_set(issued), F.lit("not_issued"))
            .when(~is_set(valid), F.lit("suspended"))
            .when(_c(expiry) <= F.lit(as_of), F.lit("expired"))
            .otherwise(F.lit("admitted")))


# U1 -------------------------------------------------------------------------
def section(is_temporary) -> Column:
    """'temporary' when the flag is truthy, else 'permanent' (NULL -> permanent)."""
    return F.when(F.coalesce(_c(is_temporary), F.lit(0)) != 0, F.lit("temporary")) \
        .otherwise(F.lit("permanent"))
