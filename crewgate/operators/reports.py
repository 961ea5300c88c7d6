"""Reports (R1-R4) and their building blocks.

Every report is a DataFrame of rows; the "file" form is a table of numbered
lines (title, header, section headings, data, totals) that any writer can
stream out in ``line_no`` order.  Counts are global aggregates (partial +
one tiny final stage); line numbers come from a range-partitioned sort, never
from a one-partition window.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewgate.functions import exprs as X
from crewgate.operators.keys import assign_ids
from crewgate.operators.listing import roster

# Column headers of the three reports.
FULL_HEADERS = ("COMPANY", "GIVEN NAME", "SURNAME", "ROLE", "DOCUMENTS EXPIRY",
                "BADGE ISSUED", "BADGE VALID")
WEEKLY_HEADERS = ("COMPANY", "GIVEN NAME", "SURNAME", "ROLE", "DOCUMENTS EXPIRY")
EXPIRED_HEADERS = ("GIVEN NAME", "SURNAME", "COMPANY", "DOCUMENTS EXPIRY")
SECTION_TITLES = {"temporary": "Short-term holders", "permanent": "Regular holders"}


def _section_ord(c="section"):
    return F.when(F.col(c) == "temporary", F.lit(0)).otherwise(F.lit(1))


def _cancel_ok(null_flag_as_zero: bool):
    c = F.col("badge_cancelled")
    return (F.coalesce(c, F.lit(0)) if null_flag_as_zero else c) == 0


def _is_weekly(null_flag_as_zero: bool = False):
    return (F.col("badge_valid") == 1) & _cancel_ok(null_flag_as_zero)


def _is_expired(as_of: dt.date, null_flag_as_zero: bool = False):
    return ((F.col("expiry_date") <= F.lit(as_of)) & (F.col("badge_issued") == 1)
            & _cancel_ok(null_flag_as_zero) & (F.col("badge_valid") == 1))


# R1 -------------------------------------------------------------------------
def full_roster(W: DataFrame, C: DataFrame, R: DataFrame,
                collation: str | None = None) -> DataFrame:
    """Every worker of a known company (cancelled badges included), with X
    marks; by company name (under ``collation`` when given)."""
    return roster(W, C, R).select(
        "worker_id", "company_name", "given_name", "surname",
        X.blank_if_null("role_name").alias("role_name"),
        X.display_date("expiry_date").alias("expiry_text"),
        X.x_mark("badge_issued").alias("issued_mark"),
        X.x_mark("badge_valid").alias("valid_mark"),
    ).orderBy(X.sort_key("company_name", collation).asc(), F.col("worker_id").asc())


# R2 F6 U1 O5 ----------------------------------------------------------------
def weekly_valid(W: DataFrame, C: DataFrame, R: DataFrame,
                 null_flag_as_zero: bool = False, collation: str | None = None) -> DataFrame:
    """Valid, not cancelled badges in two sections, sorted case-insensitively
    (or under ``collation``) by company, surname, given name within each
    section."""
    rows = roster(W.where(_is_weekly(null_flag_as_zero)), C, R)
    return rows.select(
        "worker_id",
        X.blank_if_null("company_name").alias("company_name"),
        X.blank_if_null("given_name").alias("given_name"),
        X.blank_if_null("surname").alias("surname"),
        X.blank_if_null("role_name").alias("role_name"),
        X.display_date("expiry_date").alias("expiry_text"),
        X.section("is_temporary").alias("section"),
    ).orderBy(*weekly_order(collation))


def weekly_order(collation: str | None = None) -> list:
    return [_section_ord(), X.fold("company_name", collation), X.fold("surname", collation),
            X.fold("given_name", collation), F.col("worker_id")]


# A2 A3 ----------------------------------------------------------------------
def roster_totals(rows: DataFrame) -> DataFrame:
    """One row: distinct non-empty company names (exact text) and rows."""
    return rows.agg(
        F.count_distinct(F.nullif(F.col("company_name"), F.lit(""))).alias("n_companies"),
        F.count(F.lit(1)).alias("n_workers"))


# R3 F7 O4 -------------------------------------------------------------------
def expired(W: DataFrame, C: DataFrame, as_of: dt.date,
            null_flag_as_zero: bool = False, collation: str | None = None) -> DataFrame:
    """Issued, valid, not cancelled badges whose documents expired on or
    before ``as_of``; temporary first, then by company, surname, given name."""
    return roster(W.where(_is_expired(as_of, null_flag_as_zero)), C).select(
        "worker_id", "given_name", "surname", "company_name", "expiry_date", "is_temporary",
        X.section("is_temporary").alias("section"),
        X.display_date("expiry_date").alias("expiry_text"),
    ).orderBy(F.col("is_temporary").desc(), X.sort_key("company_name", collation).asc(),
              X.sort_key("surname", collation).asc(), X.sort_key("given_name", collation).asc(),
              F.col("worker_id").asc())


# A1 A3 A8 -------------------------------------------------------------------
def section_totals(rows: DataFrame, section_col: str = "section") -> DataFrame:
    """One row: n_temporary, n_permanent, n_total (a single global aggregate)."""
    s = F.col(section_col)
    return rows.agg(F.count_if(s == "temporary").alias("n_temporary"),
                    F.count_if(s == "permanent").alias("n_permanent"),
                    F.count(F.lit(1)).alias("n_total"))


def section_counts(rows: DataFrame, section_col: str = "section") -> DataFrame:
    """Three rows (temporary, permanent, total) with their counts, zeros included."""
    return section_totals(rows, section_col).selectExpr(
        "stack(3, 'temporary', n_temporary, 'permanent', n_permanent, 'total', n_total)"
        " as (section, n)")


# A4 -------------------------------------------------------------------------
@dataclass(frozen=True)
class Widths:
    """How a report's column widths follow from its texts: the longest text or the
    header, whichever is longer (text capped at ``cap``), plus ``pad``; columns
    whose index is in ``fixed`` get exactly the header length.  Values are measured
    on their string form (a date as yyyy-MM-dd); ``skip_empty`` ignores empty
    ones, otherwise NULL counts as ''."""
    columns: tuple
    headers: tuple
    pad: int
    cap: int | None = None
    fixed: tuple = ()
    skip_empty: bool = False


WEEKLY_WIDTHS = Widths(("company_name", "given_name", "surname", "role_name", "expiry_text"),
                       WEEKLY_HEADERS, pad=10)
FULL_WIDTHS = Widths(("company_name", "given_name", "surname", "role_name", "expiry_text",
                      "issued_mark", "valid_mark"), FULL_HEADERS, pad=10, fixed=(4, 5, 6))
EXPIRED_WIDTHS = Widths(("given_name", "surname", "company_name", "expiry_date"),
                        EXPIRED_HEADERS, pad=5, cap=50, skip_empty=True)


def column_widths(rows: DataFrame, reports: dict) -> DataFrame:
    """(report, column_index, header, width) in one pass over ``rows``.

    ``reports`` maps a report's name to (``Widths``, condition): the rows of
    ``rows`` that it shows."""
    longest, cells = [], []
    for name, (spec, shown) in reports.items():
        for i, h in enumerate(spec.headers):
            if i in spec.fixed:
                width = F.lit(len(h))
            else:
                text = F.col(spec.columns[i]).cast("string")
                text = F.nullif(text, F.lit("")) if spec.skip_empty else X.blank_if_null(text)
                longest.append(F.max(F.when(shown, F.length(text))).alias(f"{name}_{i}"))
                m = F.coalesce(F.col(f"{name}_{i}"), F.lit(0))
                if spec.cap is not None:
                    m = F.least(m, F.lit(spec.cap))
                width = F.greatest(F.lit(len(h)), m) + F.lit(spec.pad)
            cells.append(F.struct(F.lit(name).alias("report"), F.lit(i).alias("column_index"),
                                  F.lit(h).alias("header"), width.cast("int").alias("width")))
    return rows.agg(*longest).select(F.inline(F.array(*cells)))


def text_widths(rows: DataFrame, columns: list[str], headers: list[str], pad: int,
                cap: int | None = None, fixed: tuple = (), skip_empty: bool = False) -> DataFrame:
    """Display width per column of one report (see ``Widths``)."""
    spec = Widths(tuple(columns), tuple(headers), pad, cap, tuple(fixed), skip_empty)
    return column_widths(rows, {"r": (spec, F.lit(True))}).drop("report")


def all_widths(W: DataFrame, C: DataFrame, R: DataFrame, as_of: dt.date) -> DataFrame:
    """The widths of the three reports from one join and one aggregate."""
    rows = roster(W, C, R).withColumns({
        "expiry_text": X.display_date("expiry_date"),
        "issued_mark": X.x_mark("badge_issued"), "valid_mark": X.x_mark("badge_valid")})
    return column_widths(rows, {"weekly": (WEEKLY_WIDTHS, _is_weekly()),
                                "full": (FULL_WIDTHS, F.lit(True)),
                                "expired": (EXPIRED_WIDTHS, _is_expired(as_of))})


# U3 K3 ----------------------------------------------------------------------
@dataclass(frozen=True)
class ReportSpec:
    """Layout of a report: its title, the header and source column of every cell,
    the data order (columns, or a function of the collation), whether rows come
    in two sections, and the totals after ``gap`` blank lines."""
    title: str
    headers: tuple
    columns: tuple
    order: Callable
    sections: bool = True
    gap: int = 0
    totals: tuple = ()


def full_order(collation: str | None = None) -> list:
    return [X.sort_key("company_name", collation), F.col("worker_id")]


def expired_order(collation: str | None = None) -> list:
    return [_section_ord(), -F.col("is_temporary"), X.sort_key("company_name", collation),
            X.sort_key("surname", collation), X.sort_key("given_name", collation),
            F.col("worker_id")]


FULL = ReportSpec(
    "Site roster, state of {day}", FULL_HEADERS,
    ("company_name", "given_name", "surname", "role_name", "expiry_text", "issued_mark",
     "valid_mark"), full_order, sections=False)
WEEKLY = ReportSpec(
    "Active badges by company, state of {day}", WEEKLY_HEADERS,
    ("company_name", "given_name", "surname", "role_name", "expiry_text"), weekly_order, gap=2,
    totals=("{n_companies} companies listed", "{n_rows} badge holders listed"))
EXPIRED = ReportSpec(
    "Badges with lapsed documents, state of {day}", EXPIRED_HEADERS,
    ("given_name", "surname", "company_name", "expiry_text"), expired_order, gap=1,
    totals=("{n_temporary} short-term badges", "{n_permanent} regular badges",
            "{n_rows} badges in all"))


def report_lines(rows: DataFrame, spec: ReportSpec, as_of: dt.date,
                 collation: str | None = None) -> DataFrame:
    """A report as numbered sheet lines (line_no, kind, section, c0, c1, ...).

    ``rows`` is the output of ``full_roster``, ``weekly_valid`` or ``expired``.
    Line 0 is the title, 1 the header; with sections, each non-empty one gets a
    heading line and its data lines; totals follow the blank lines.  ``line_no``
    is the sheet row, so gaps are blank rows.  Data positions come from
    ``assign_ids`` (range sort).
    """
    cells = [f"c{i}" for i in range(len(spec.headers))]
    section = F.col("section") if spec.sections else F.lit(None).cast("string")
    keys = [f"_k{i}" for i in range(len(spec.order(collation)))]
    order = spec.order(collation)
    ordered = rows.withColumn("_section", section)
    # only cells, section and sort keys are moved; the order is kept as columns
    kept = ordered.select(
        "_section", F.nullif(F.col("company_name"), F.lit("")).alias("_firm"),
        *[X.blank_if_null(c).alias(n) for c, n in zip(spec.columns, cells)],
        *[o.alias(k) for o, k in zip(order, keys)])
    positioned = assign_ids(kept, keys, 0, "_p")
    # one summary row (four counts) is all the driver sees; it is counted
    # from the checkpointed positions, not by re-running the report's joins
    t = positioned.agg(
        F.count_if(F.col("_section") == "temporary").alias("n_temporary"),
        F.count_if(F.col("_section") == "permanent").alias("n_permanent"),
        F.count_distinct("_firm").alias("n_companies"),
        F.count(F.lit(1)).alias("n_rows")).first().asDict()
    n_t, n_p = t["n_temporary"], t["n_permanent"]
    headings = int(spec.sections and n_t > 0)
    first = 2 + headings
    data = positioned.select(
        (F.lit(first) + F.col("_p")
         + F.when(F.col("_section") == "permanent", F.lit(1)).otherwise(F.lit(0)))
        .cast("long").alias("line_no"),
        F.lit("data").alias("kind"), F.col("_section").alias("section"), *cells)
    fixed = [(0, "title", None, spec.title.format(day=as_of.strftime("%d-%m-%Y"))),
             (1, "header", None, *spec.headers)]
    if headings:
        fixed.append((2, "section", "temporary", SECTION_TITLES["temporary"]))
    if spec.sections and n_p > 0:
        fixed.append((2 + headings + n_t, "section", "permanent", SECTION_TITLES["permanent"]))
    end = 2 + t["n_rows"] + headings + int(spec.sections and n_p > 0) + spec.gap
    fixed += [(end + i, "total", None, text.format(**t)) for i, text in enumerate(spec.totals)]
    fixed = [tuple(r) + (None,) * (3 + len(cells) - len(r)) for r in fixed]
    schema = "line_no long, kind string, section string, " + ", ".join(
        f"{c} string" for c in cells)
    return data.unionByName(rows.sparkSession.createDataFrame(fixed, schema))


def write_lines(lines: DataFrame, path: str, by_section: bool = False) -> None:
    """K3: write report lines as ';' CSV, range-partitioned by line number so
    that file order is line order (no single-file coalesce).  With
    ``by_section`` each section's lines go to their own ``section=...``
    folder (title, header and totals under ``section=__HIVE_DEFAULT_PARTITION__``)."""
    ordered = lines.repartitionByRange("line_no").sortWithinPartitions("line_no")
    writer = ordered.write.mode("error").option("sep", ";").option("header", "true") \
        .option("escape", '"')
    if by_section:
        writer = writer.partitionBy("section")
    writer.csv(path)


# A6 A7 F10 ------------------------------------------------------------------
def recipients_for(recipients: DataFrame, list_name: str, default: str | None = None,
                   drop_blank: bool = False) -> DataFrame:
    """E-mail rows of one list; the ``default`` address when the list is empty.
    ``drop_blank`` strips each address and drops the blank ones (weekly list)."""
    rows = recipients.where(F.col("list_name") == F.lit(list_name)).select("list_name", "email")
    if drop_blank:
        rows = rows.select("list_name", X.strip_ws("email").alias("email")) \
                   .where(F.col("email") != "")
    if default is None:
        return rows
    spark = recipients.sparkSession
    fallback = spark.createDataFrame([(list_name, default)], "list_name string, email string")
    present = rows.select("list_name").limit(1)
    return rows.unionByName(fallback.join(present, "list_name", "left_anti"))


def recipient_lines(to: DataFrame, size: int = 500) -> DataFrame:
    """The addresses of ``recipients_for`` in order as comma lists of ``size``
    recipients, which concatenate to the whole sorted list.

    Columns: list_name, line (from 0), first_recipient (running number from 1),
    n_in_line, n_recipients (of the whole list), recipients.  Numbers come from a range
    sort, so no task folds more than ``size`` addresses; repeated ones stay.
    """
    numbered = assign_ids(to.select("list_name", "email"), ["email"], 0, "_p")
    total = numbered.count()
    line = F.floor(F.col("_p") / size)
    return numbered.groupBy("list_name", line.alias("line")).agg(
        (F.min("_p") + 1).alias("first_recipient"), F.count(F.lit(1)).alias("n_in_line"),
        F.expr("listagg(coalesce(email, ''), ', ') WITHIN GROUP (ORDER BY coalesce(email, ''))")
        .alias("recipients")).withColumn("n_recipients", F.lit(total).cast("long"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of ``write_lines`` with their ``position`` in file order (from 0); an
    empty cell of a data line is '', one of another line NULL, as ``report_lines`` has them."""
    lines = spark.read.option("sep", ";").option("header", "true").option("multiLine", "true") \
        .option("escape", '"').csv(path)
    placed = lines.select(F.col("line_no").cast("long").alias("line_no"),
                          "kind", "section", *[
                              F.when(F.col("kind") == "data", F.coalesce(c, F.lit("")))
                              .otherwise(F.col(c)).alias(c) for c in lines.columns[3:]],
                          F.col("_metadata.file_name").alias("_file"),
                          F.monotonically_increasing_id().alias("_at"))
    return assign_ids(placed, ["_file", "_at"], 0, "position").drop("_file", "_at")


# R4 A8 P7 P23 ---------------------------------------------------------------
# Message wording (ours) and attachment names of the two mails.
EXPIRED_SUBJECT = "Expired documents: {n} workers ({day})"
EXPIRED_BODY = ("As of {day}, {t} temporary and {p} permanent badge holders have expired "
                "documents.")
NONE_EXPIRED_BODY = "As of {day}, no badge holder has expired documents."
EXPIRED_ATTACHMENT = "expired_badges_{stamp}.csv"
WEEKLY_SUBJECT = "Active badges on {day}"
WEEKLY_BODY = "{w} holders of an active badge from {c} companies are listed, state of {day}."
WEEKLY_ATTACHMENT = "active_badges_{stamp}.csv"


def _messages(to: DataFrame, subject: str, body: str, attachment: str | None,
              counts: dict) -> DataFrame:
    return to.select(
        "list_name", F.col("email").alias("recipient"), F.lit(subject).alias("subject"),
        F.lit(body).alias("body"), F.lit(attachment).cast("string").alias("attachment"),
        *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


def digest(expired_rows: DataFrame, recipients: DataFrame, as_of: dt.date,
           list_name: str = "expired", default: str | None = None,
           when_empty: bool = False) -> DataFrame:
    """One message row per recipient when anything expired; none otherwise,
    or a "nothing expired" message without attachment when ``when_empty``.

    The counts are one global aggregate; its single row is the only thing
    the driver reads, and it becomes literals on the recipient rows.
    """
    t = section_totals(expired_rows).first()
    to = recipients_for(recipients, list_name, default)
    day = as_of.strftime("%d/%m/%Y")
    counts = {"n_temporary": t["n_temporary"], "n_permanent": t["n_permanent"],
              "n_total": t["n_total"]}
    if t["n_total"] == 0:
        if not when_empty:
            to = to.where(F.lit(False))
        return _messages(to, EXPIRED_SUBJECT.format(n=0, day=day),
                         NONE_EXPIRED_BODY.format(day=day), None, counts)
    return _messages(to, EXPIRED_SUBJECT.format(n=t["n_total"], day=day),
                     EXPIRED_BODY.format(day=day, t=t["n_temporary"], p=t["n_permanent"]),
                     EXPIRED_ATTACHMENT.format(stamp=as_of.strftime("%d-%m-%Y")), counts)


def weekly_digest(weekly_rows: DataFrame, recipients: DataFrame, as_of: dt.date,
                  list_name: str = "weekly") -> DataFrame:
    """One message row per address of the weekly list (addresses stripped,
    blanks dropped), sent whatever the report holds.  An empty list is an
    error, as there is nobody to send the report to."""
    to = recipients_for(recipients, list_name, drop_blank=True)
    if to.isEmpty():
        raise ValueError(f"mailing list {list_name!r} has no address")
    t = roster_totals(weekly_rows).first()
    day = as_of.strftime("%d/%m/%Y")
    return _messages(to, WEEKLY_SUBJECT.format(day=day),
                     WEEKLY_BODY.format(day=day, w=t["n_workers"], c=t["n_companies"]),
                     WEEKLY_ATTACHMENT.format(stamp=as_of.strftime("%d_%m_%Y")),
                     {"n_companies": t["n_companies"], "n_workers": t["n_workers"]})
