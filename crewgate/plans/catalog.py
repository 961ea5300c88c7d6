"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the whole test tables through the stand-in views of
``sources.testviews`` and runs the library's operators on them.  The DuckDB
text for the same result is in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewgate.functions import exprs as X
from crewgate.operators import companies, flags, greedy, keys, listing, load, quality, renames, \
    reports, request_log, upsert, workers
from crewgate.schema import COMPANIES
from crewgate.session import scratch_path
from crewgate.sources import roster_csv, tables
from crewgate.sources import testviews as V
from crewgate.streaming import flag_stream

AS_OF = V.AS_OF
# Parameters of the registered listing queries.
COMPANY_ID = 7
SURNAME_TEXT = "s9"
COMPANY_NAME = "customer#000000042"
PICKER_TEXT = "#0000001"
DEFAULT_RECIPIENT = "site-office@example.org"
ALLOWED_ACTORS = ["user0", "user1"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _wcr(spark, sf):
    return V.workers(spark, sf), V.companies(spark, sf), V.roles(spark, sf)


# --- reports -----------------------------------------------------------------
@register
def expired_badges(spark, sf):
    """Expired, issued, valid, not cancelled; mixed sort."""
    W, C, _ = _wcr(spark, sf)
    return reports.expired(W, C, AS_OF)


@register
def expired_counts(spark, sf):
    """Rows per section of the expired list plus the total."""
    W, C, _ = _wcr(spark, sf)
    return reports.section_counts(reports.expired(W, C, AS_OF))


@register
def weekly_valid(spark, sf):
    """Valid, not cancelled badges in two sections."""
    return reports.weekly_valid(*_wcr(spark, sf))


@register
def weekly_totals(spark, sf):
    """A2 A3: distinct companies and workers of the weekly list."""
    return reports.roster_totals(reports.weekly_valid(*_wcr(spark, sf)))


@register
def roster_full(spark, sf):
    """Every worker of a known company, X marks, no filter."""
    return reports.full_roster(*_wcr(spark, sf))


@register
def column_widths(spark, sf):
    """A4: display widths of the three reports' columns."""
    return reports.all_widths(*_wcr(spark, sf), AS_OF)


@register
def report_lines(spark, sf):
    """The weekly report as numbered sheet lines."""
    return reports.report_lines(reports.weekly_valid(*_wcr(spark, sf)), reports.WEEKLY, AS_OF)


@register
def expired_lines(spark, sf):
    """The expired list as numbered sheet lines."""
    W, C, _ = _wcr(spark, sf)
    return reports.report_lines(reports.expired(W, C, AS_OF), reports.EXPIRED, AS_OF)


@register
def full_lines(spark, sf):
    """The full roster as numbered sheet lines."""
    return reports.report_lines(reports.full_roster(*_wcr(spark, sf)), reports.FULL, AS_OF)


@register
def weekly_valid_null_as_zero(spark, sf):
    """The weekly list with an unknown cancelled flag read as 0."""
    return reports.weekly_valid(*_wcr(spark, sf), null_flag_as_zero=True)


@register
def digest(spark, sf):
    """One message row per recipient of the expired list."""
    W, C, _ = _wcr(spark, sf)
    return reports.digest(reports.expired(W, C, AS_OF), V.recipients(spark, sf), AS_OF,
                          default=DEFAULT_RECIPIENT)


@register
def recipient_lines(spark, sf):
    """The expired list's addresses as comma lists of seven, numbered."""
    to = reports.recipients_for(V.recipients(spark, sf), "expired", DEFAULT_RECIPIENT)
    return reports.recipient_lines(to, size=7)


@register
def report_files(spark, sf):
    """The weekly report's lines written as files and read back in order."""
    path = scratch_path(spark, "report-lines")
    reports.write_lines(report_lines(spark, sf), path)
    return reports.read_lines(spark, path)


@register
def edit_date_texts(spark, sf):
    """The expiry texts of the edit requests as a report shows them; a text that is
    no date passes through."""
    return V.worker_edits(spark, sf).select(
        "seq", X.display_date_text("expiry_date").alias("expiry_text"))


@register
def badge_status(spark, sf):
    """One badge state per worker."""
    W = V.workers(spark, sf)
    return W.select("worker_id", X.badge_status(AS_OF).alias("status"))


# --- listings ----------------------------------------------------------------
@register
def workers_by_company(spark, sf):
    """Workers of one company, by surname."""
    return listing.list_workers(*_wcr(spark, sf), company_id=COMPANY_ID)


@register
def workers_by_surname(spark, sf):
    """Surname contains a text, case-insensitive,
    with each row's position in the list."""
    return listing.positioned(listing.list_workers(*_wcr(spark, sf), surname=SURNAME_TEXT),
                              ["surname", "worker_id"])


@register
def workers_cancelled(spark, sf):
    """Cancelled badges only."""
    return listing.list_workers(*_wcr(spark, sf), cancelled=True)


@register
def companies_by_name(spark, sf):
    """Company by exact name, case-insensitive."""
    return listing.list_companies(V.companies(spark, sf), name=COMPANY_NAME)


@register
def companies_all(spark, sf):
    """Every company, by name, with its position."""
    return listing.positioned(listing.list_companies(V.companies(spark, sf)),
                              ["company_name", "company_id"])


@register
def company_picker(spark, sf):
    """(id, name, position) of companies whose name contains a text."""
    return listing.positioned(listing.company_picker(V.companies(spark, sf),
                                                     contains=PICKER_TEXT),
                              ["company_name", "company_id"])


@register
def role_list(spark, sf):
    """Roles by id, with their position."""
    return listing.positioned(listing.list_roles(V.roles(spark, sf)), ["role_id"])


# --- lookups and quality -----------------------------------------------------
@register
def workers_by_ids(spark, sf):
    """workers whose id is in a set (the users of the change feed)."""
    ids = V.table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return listing.select_by_id(V.workers(spark, sf), ids, "worker_id")


@register
def new_companies_accepted(spark, sf):
    """Requests with no stored company of the same name or VAT key."""
    return quality.new_companies(V.company_candidates(spark, sf), V.companies(spark, sf))


@register
def new_companies_greedy(spark, sf):
    """Add-company outcome, first-come rule inside the batch."""
    _, outcomes = companies.add_companies(V.company_candidates(spark, sf),
                                          V.companies(spark, sf))
    return outcomes


@register
def surrogate_keys(spark, sf):
    """Ids after the largest stored id for the new companies, in seq order."""
    C = V.companies(spark, sf)
    fresh = quality.new_companies(V.company_candidates(spark, sf), C)
    return keys.assign_ids_after(fresh.select("seq"), C, "company_id", ["seq"], "company_id")


@register
def worker_duplicates_stored(spark, sf):
    """Requests equal to a stored worker (names case-insensitive, company)."""
    cand = listing.resolve_company(V.worker_candidates(spark, sf), V.companies(spark, sf))
    return quality.existing_workers(cand, V.workers(spark, sf)).select(
        "seq", "given_name", "surname", "company_id")


@register
def new_workers_outcomes(spark, sf):
    """Add-worker outcome per request, ids for
    accepted ones."""
    _, outcomes = workers.add_workers(V.worker_candidates(spark, sf), V.workers(spark, sf),
                                      V.companies(spark, sf))
    return outcomes


@register
def orphans(spark, sf):
    """Workers whose company or role id has no parent row."""
    return quality.worker_orphans(*_wcr(spark, sf))


@register
def duplicate_keys(spark, sf):
    """VAT keys held by more than one company."""
    return quality.duplicate_keys(V.companies(spark, sf),
                                  [X.stored_vat_key("vat_number").alias("vat_key")])


@register
def conformance_rejects(spark, sf):
    """Q1: company requests that break the column length limits."""
    return quality.conformance_rejects(V.company_candidates(spark, sf), COMPANIES, "seq")


@register
def temporary_without_date(spark, sf):
    """Q2: temporary badges with no expiry date."""
    W = V.workers(spark, sf)
    return W.where(quality.temporary_without_date("is_temporary", "expiry_date")) \
            .select("worker_id", "company_id")


# --- changes -------------------------------------------------------------------
@register
def worker_edits(spark, sf):
    """Worker snapshot after the edit requests."""
    new_w, _ = workers.edit_workers(V.worker_edits(spark, sf), *_wcr(spark, sf),
                                    with_outcomes=False)
    return new_w


@register
def worker_edit_outcomes(spark, sf):
    """Outcome per edit request."""
    _, outcomes = workers.edit_workers(V.worker_edits(spark, sf), *_wcr(spark, sf))
    return outcomes


@register
def company_edits(spark, sf):
    """Company snapshot after the edit requests."""
    new_c, _ = companies.edit_companies(V.company_edits(spark, sf), V.companies(spark, sf))
    return new_c


@register
def company_edit_outcomes(spark, sf):
    """Outcome per edit request."""
    return companies.edit_companies(V.company_edits(spark, sf), V.companies(spark, sf))[1]


@register
def flag_changes_snapshot(spark, sf):
    """Worker snapshot after the flag changes."""
    W, C, _ = _wcr(spark, sf)
    new_w, _, _ = flags.apply_flag_changes(V.flag_change_records(spark, sf), W, C,
                                           ALLOWED_ACTORS, with_outcomes=False)
    return new_w


@register
def flag_changes_companies(spark, sf):
    """Company snapshot after the flag changes."""
    W, C, _ = _wcr(spark, sf)
    _, new_c, _ = flags.apply_flag_changes(V.flag_change_records(spark, sf), W, C,
                                           ALLOWED_ACTORS, with_outcomes=False)
    return new_c


@register
def flag_change_outcomes(spark, sf):
    """Reason per change record."""
    W, C, _ = _wcr(spark, sf)
    return flags.change_outcomes(V.flag_change_records(spark, sf), W, C, ALLOWED_ACTORS)


@register
def delete_companies_cascade(spark, sf):
    """Workers left after deleting companies (cascade)."""
    W, C, _ = _wcr(spark, sf)
    return companies.delete_companies(V.company_deletions(spark, sf), C, W)[1]


@register
def role_set_null(spark, sf):
    """Workers after deleting a role (their role becomes NULL)."""
    W, _, R = _wcr(spark, sf)
    return workers.delete_roles(V.role_deletions(spark, sf), R, W)[1]


@register
def delete_workers(spark, sf):
    """Workers left after deleting a set of workers."""
    return workers.delete_workers(V.worker_deletions(spark, sf), V.workers(spark, sf))[0]


@register
def deletion_outcomes(spark, sf):
    """Outcome per deletion request, for workers, companies and roles."""
    W, C, R = _wcr(spark, sf)
    asked = V.repeated_deletions(spark, sf)
    parts = [("worker", workers.delete_workers(asked, W)[1]),
             ("company", companies.delete_companies(asked, C, W)[2]),
             ("role", workers.delete_roles(asked, R, W)[2])]
    return reduce(DataFrame.unionByName, [o.withColumn("type", F.lit(t)) for t, o in parts])


@register
def upsert_by_key(spark, sf):
    """Contact table after an upsert batch."""
    return upsert.upsert(V.contact_updates(spark, sf), V.contact_table(spark, sf),
                         "company_id", V.UPSERT_NOW)


def _applied_log(spark, sf):
    W, C, _ = _wcr(spark, sf)
    return request_log.apply_log(V.mixed_log(spark, sf), W, C)


@register
def request_log_outcomes(spark, sf):
    """Outcome per row of a log that mixes additions and deletions of
    companies and workers, in order of arrival."""
    return _applied_log(spark, sf)[2]


@register
def request_log_workers(spark, sf):
    """Workers after that log."""
    return _applied_log(spark, sf)[1]


@register
def upsert_outcomes(spark, sf):
    """Outcome per request of the upsert batch."""
    return upsert.upsert_outcomes(V.contact_updates(spark, sf), V.contact_table(spark, sf),
                                  "company_id")


# --- bulk load and stream ----------------------------------------------------
def _clean(spark, sf):
    path = V.write_raw_roster(spark, sf, scratch_path(spark, "raw-roster"))
    return load.clean_roster(roster_csv.read_roster_csv(spark, path))


def _loaded(spark, sf):
    return load.bulk_load(_clean(spark, sf), V.companies(spark, sf), V.workers(spark, sf))


@register
def bulk_load(spark, sf):
    """Workers loaded from a raw roster CSV folder."""
    return _loaded(spark, sf)[1]


@register
def bulk_load_companies(spark, sf):
    """Companies created by the load."""
    return load.load_companies(_clean(spark, sf), V.companies(spark, sf))


@register
def bulk_load_outcomes(spark, sf):
    """Outcome per raw record (loaded / too long, date warning)."""
    return _loaded(spark, sf)[2].select("worker_id", "outcome", "warning")


@register
def clean_csv_roundtrip(spark, sf):
    """The cleaned roster written as CSV and read back."""
    out = scratch_path(spark, "clean-roster")
    roster_csv.write_clean_csv(_clean(spark, sf), out)
    return roster_csv.read_clean_csv(spark, out)


@register
def snapshot_roundtrip(spark, sf):
    """Workers appended in two parts and written as a version, read back."""
    W = V.workers(spark, sf)
    root = scratch_path(spark, "tables")
    tables.append_rows(W.where("is_temporary = 1"), root, "workers")
    tables.append_rows(W.where("is_temporary <> 1"), root, "workers")
    appended = tables.read_table(spark, root, "workers")
    tables.write_snapshot(appended, f"{root}/versions", "workers", 1,
                          sort_within=["company_id", "expiry_date"])
    return tables.read_table(spark, f"{root}/versions", "workers", 1)


@register
def company_remap(spark, sf):
    """Workers after some companies changed their id (ON UPDATE CASCADE)."""
    return renames.remap_keys(V.company_remaps(spark, sf), V.companies(spark, sf),
                              V.workers(spark, sf), "company_id", "company_id")[1]


def _key_changes(spark, sf):
    return renames.remap_keys(V.company_key_changes(spark, sf), V.companies(spark, sf),
                              V.workers(spark, sf), "company_id", "company_id")


@register
def key_change_outcomes(spark, sf):
    """Outcome per key change of a batch whose requests free and take each
    other's ids."""
    return _key_changes(spark, sf)[2]


@register
def key_change_companies(spark, sf):
    """Companies after those key changes."""
    return _key_changes(spark, sf)[0]


@register
def key_change_workers(spark, sf):
    """Workers after those key changes (their company id follows)."""
    return _key_changes(spark, sf)[1]


def _backlog(spark, feed):
    return flag_stream.read_change_stream(spark, feed, flag_stream.files_per_batch(spark, feed))


@register
def stream_flag_changes(spark, sf):
    """The change feed in micro-batches (appended to a stored
    table, read back); snapshot equals D5's."""
    W, C, _ = _wcr(spark, sf)
    feed = scratch_path(spark, "flag-feed")
    V.write_change_files(spark, sf, feed)
    root = scratch_path(spark, "flag-state")
    q = flag_stream.start_flag_stream(_backlog(spark, feed), root, f"{root}/_checkpoint",
                                      ALLOWED_ACTORS)
    q.awaitTermination()
    new_w, _ = flags.apply_latest(flag_stream.state_rows(spark, root), W, C)
    return new_w


@register
def stream_flag_outcomes(spark, sf):
    """What became of every record of the change feed, written batch by
    batch and read back; equals the batch operator's outcomes row by row."""
    W, C, _ = _wcr(spark, sf)
    feed = scratch_path(spark, "flag-feed")
    V.write_change_files(spark, sf, feed)
    root = scratch_path(spark, "flag-outcomes")
    q = flag_stream.start_outcome_stream(_backlog(spark, feed), root, f"{root}/_checkpoint",
                                         ALLOWED_ACTORS)
    q.awaitTermination()
    return flag_stream.feed_outcomes(spark, root, W, C)


# --- detail views and mailing lists --------------------------------------------
@register
def worker_detail(spark, sf):
    """Edit-form view of the workers named by the change feed."""
    ids = V.table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return listing.worker_detail(V.workers(spark, sf), V.companies(spark, sf), ids)


@register
def company_detail(spark, sf):
    """edit-form view of the companies named by the change feed."""
    ids = V.table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return listing.company_detail(V.companies(spark, sf), ids)


@register
def weekly_digest(spark, sf):
    """The weekly report's message, one row per address."""
    W, C, R = _wcr(spark, sf)
    return reports.weekly_digest(reports.weekly_valid(W, C, R), V.recipients(spark, sf), AS_OF)


@register
def weekly_recipients(spark, sf):
    """The weekly list's addresses, stripped, blanks dropped."""
    return reports.recipients_for(V.recipients(spark, sf), "weekly", drop_blank=True)


@register
def companies_first_come(spark, sf):
    """Stored companies taken in id order under the first-come
    rule (no earlier kept company with the same name or VAT key); kept flag."""
    C = V.companies(spark, sf)
    keyed = C.select(F.col("company_id").alias("seq"),
                     X.name_key("company_name").alias("_nk"),
                     X.stored_vat_key("vat_number").alias("_vk"))
    kept = greedy.first_by_keys(keyed, ["_nk", "_vk"], "seq").select(
        F.col("seq").alias("company_id"), F.lit(True).alias("kept"))
    return C.select("company_id").join(kept, "company_id", "left").select(
        "company_id", F.coalesce(F.col("kept"), F.lit(False)).alias("kept"))
