"""Worker changes: add (D2), edit (D3), delete (D6) and role delete (D6, the
declared ON DELETE SET NULL); key changes are in ``renames``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.functions import exprs as X
from crewgate.operators import quality
from crewgate.operators.deletions import split_requests
from crewgate.operators.keys import assign_ids_after
from crewgate.operators.listing import resolve_company
from crewgate.operators.sizing import join_spread, present_keys
from crewgate.schema import WORKERS, conform
from crewgate.session import ensure_checkpoint_dir

# Outcome codes of worker requests, in the order they are tested.
NO_COMPANY = "no_company"
BAD_ROLE = "bad_role"
BAD_DATE = "bad_date"
COMPANY_UNKNOWN = "company_unknown"
DUPLICATE = "duplicate"
TEMP_NO_DATE = "temporary_without_date"
NOT_FOUND = "not_found"
ROLE_UNKNOWN = "role_unknown"
ACCEPTED = "accepted"
APPLIED = "applied"


def add_workers(cand: DataFrame, W: DataFrame, C: DataFrame,
                collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate and add workers.

    ``cand``: seq, given_name, surname, company_name, is_temporary ('on'),
    badge_number, role_id (text), expiry_date (ISO text), note.  Reasons in
    order: no company chosen, bad role id, bad date, company unknown,
    duplicate (a stored worker, or an earlier *accepted* request, with the
    same lower-case names and company), temporary badge without a date.
    New workers start with the four status flags at 0.  ``collation`` (e.g.
    UNICODE_CI_AI) applies to the company lookup and the duplicate key.
    """
    r = with_checks(resolve_company(cand, C, collation=collation), collation)
    # the resolved batch feeds three consumers (stored keys, first per key, the
    # decision): write it once to the shared checkpoint folder
    ensure_checkpoint_dir(r.sparkSession)
    r = decide(r.checkpoint(eager=True), W, collation).checkpoint(eager=True)
    accepted = assign_ids_after(accepted_rows(r), W, "worker_id", ["seq"], "worker_id")
    outcomes = accepted.select("seq", F.lit(ACCEPTED).alias("outcome"), "company_id",
                               "worker_id").unionByName(
        r.where(F.col("_reason").isNotNull()).select(
            "seq", F.col("_reason").alias("outcome"), "company_id",
            F.lit(None).cast("long").alias("worker_id")))
    return W.unionByName(conform(accepted, WORKERS)), outcomes


def with_checks(r: DataFrame, collation: str | None = None) -> DataFrame:
    """Requests with a resolved ``company_id``, their typed fields and worker key."""
    return r.select(
        "*",
        X.optional_id("role_id").alias("_role"), X.bad_id("role_id").alias("_bad_role"),
        X.iso_date("expiry_date").alias("_date"),
        X.bad_iso_date("expiry_date").alias("_bad_date"),
        X.checkbox("is_temporary").alias("_temp"),
        *quality.worker_key_cols(collation=collation))


def with_early(r: DataFrame) -> DataFrame:
    """``with_checks`` rows with the reason that needs no other row (``_early``) and
    whether a temporary badge's date is missing."""
    early = (F.when(F.col("company_name") == "", F.lit(NO_COMPANY))
              .when(F.col("_bad_role"), F.lit(BAD_ROLE))
              .when(F.col("_bad_date"), F.lit(BAD_DATE))
              .when(F.col("company_id").isNull(), F.lit(COMPANY_UNKNOWN)))
    return r.withColumn("_early", early).withColumn(
        "_temp_no_date", (F.col("_temp") == 1) & F.col("_date").isNull())


def accepted_rows(r: DataFrame) -> DataFrame:
    """The worker rows (without an id) of the requests that have no ``_reason``."""
    return r.where(F.col("_reason").isNull()).select(
        "seq", "given_name", "surname", "company_id",
        F.col("_role").alias("role_id"),
        F.lit(0).alias("badge_issued"), F.col("_date").alias("expiry_date"),
        F.lit(0).alias("record_updated"), F.lit(0).alias("badge_valid"),
        X.blank_if_null("note").alias("note"), F.lit(0).alias("badge_cancelled"),
        F.col("_temp").alias("is_temporary"),
        X.badge_number_if_temporary(F.col("_temp"), F.col("badge_number")).alias("badge_number"))


def decide(r: DataFrame, W: DataFrame, collation: str | None = None) -> DataFrame:
    """``r`` (resolved requests with their keys) with ``_reason``, NULL when accepted.

    Stored matches and eligible requests meet in one aggregate by worker key:
    whether it is stored, and the lowest seq of a request that passes every other
    check (only those are inserted, so only they block later ones).  One row per
    key joins back, so a key that many requests share is split by AQE.
    """
    key = list(quality.WORKER_KEY)
    r = with_early(r)
    eligible = r.where(F.col("_early").isNull() & ~F.col("_temp_no_date")).dropna(subset=key).select(
        *key, "seq", F.lit(False).alias("_stored"))
    hits = quality.stored_matches(r, W, collation).select(
        *key, F.lit(None).cast("long").alias("seq"), F.lit(True).alias("_stored"))
    per_key = eligible.unionByName(hits).groupBy(*key).agg(
        F.min("seq").alias("_first"), F.max("_stored").alias("_stored"))
    joined = r.join(per_key, key, "left")
    return joined.withColumn("_reason", F.coalesce(
        F.col("_early"),
        F.when(F.col("_stored") | (F.col("_first") < F.col("seq")), F.lit(DUPLICATE)),
        F.when(F.col("_temp_no_date"), F.lit(TEMP_NO_DATE))))


EDIT_FIELDS = ("given_name", "surname", "company_id", "role_id", "expiry_date", "note",
               "is_temporary", "badge_number")


def edit_workers(edits: DataFrame, W: DataFrame, C: DataFrame | None = None,
                 R: DataFrame | None = None, with_outcomes: bool = True
                 ) -> tuple[DataFrame, DataFrame | None]:
    """D3: edit workers.

    ``edits``: seq, worker_id, given_name, surname, company_id, role_id
    (text), is_temporary ('on'), badge_number, expiry_date (ISO text),
    clear_date_flag ('1' clears), note.  Reasons in order: bad role id,
    worker not found, bad date (not read when clearing), temporary badge
    without a date (after clearing), then — when C / R are given — a company
    or role id with no parent row (the foreign keys refuse it).  The four
    status flags are kept; of several valid edits of one worker the last by
    seq wins.  The snapshot needs no "not found" check (an edit of a missing
    id joins no row); ``with_outcomes=False`` skips it and the outcomes.
    """
    clear = F.coalesce(F.col("clear_date_flag") == "1", F.lit(False))
    e = edits.select(
        "*",
        X.optional_id("role_id").alias("_role"), X.bad_id("role_id").alias("_bad_role"),
        F.when(clear, F.lit(None).cast("date")).otherwise(X.iso_date("expiry_date"))
         .alias("_date"),
        (~clear & X.bad_iso_date("expiry_date")).alias("_bad_date"),
        X.checkbox("is_temporary").alias("_temp"))
    if with_outcomes:
        found = present_keys(W, e, ["worker_id"]).withColumn("_found", F.lit(True))
        e = e.join(found, "worker_id", "left")
    else:
        e = e.withColumn("_found", F.lit(True))
    reason = (F.when(F.col("_bad_role"), F.lit(BAD_ROLE))
               .when(F.col("_found").isNull(), F.lit(NOT_FOUND))
               .when(F.col("_bad_date"), F.lit(BAD_DATE))
               .when((F.col("_temp") == 1) & F.col("_date").isNull(), F.lit(TEMP_NO_DATE)))
    if C is not None:
        e = e.join(C.select("company_id", F.lit(True).alias("_c_ok")), "company_id", "left")
        reason = reason.when(F.col("company_id").isNotNull() & F.col("_c_ok").isNull(),
                             F.lit(COMPANY_UNKNOWN))
    if R is not None:
        e = e.join(R.select(F.col("role_id").alias("_role"), F.lit(True).alias("_r_ok")),
                   "_role", "left")
        reason = reason.when(F.col("_role").isNotNull() & F.col("_r_ok").isNull(),
                             F.lit(ROLE_UNKNOWN))
    e = e.withColumn("_reason", reason)
    new_vals = F.struct(
        F.col("given_name"), F.col("surname"), F.col("company_id"),
        F.col("_role").alias("role_id"), F.col("_date").alias("expiry_date"),
        F.col("note"), F.col("_temp").alias("is_temporary"),
        X.badge_number_if_temporary(F.col("_temp"), F.col("badge_number")).alias("badge_number"))
    latest = (e.where(F.col("_reason").isNull()).groupBy("worker_id")
               .agg(F.max_by(new_vals, F.col("seq")).alias("_new"),
                    F.max("seq").alias("_seq")))
    joined = W.join(latest, "worker_id", "left")
    edited = F.col("_seq").isNotNull()
    new_w = joined.select(
        "worker_id",
        *[F.when(edited, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in EDIT_FIELDS],
        "badge_issued", "record_updated", "badge_valid", "badge_cancelled")
    outcomes = e.select("seq", "worker_id",
                        F.coalesce(F.col("_reason"), F.lit(APPLIED)).alias("outcome")) \
        if with_outcomes else None
    return conform(new_w, WORKERS), outcomes


def delete_workers(requests: DataFrame, W: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove workers by id; ``requests``: seq, id.  Returns (workers, outcomes)."""
    gone, outcomes = split_requests(requests, W, "worker_id")
    return W.join(gone, "worker_id", "left_anti"), outcomes


def delete_roles(requests: DataFrame, R: DataFrame,
                 W: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove roles; workers holding one keep their row with role NULL.
    ``requests``: seq, id.  Returns (roles, workers, outcomes)."""
    gone, outcomes = split_requests(requests, R, "role_id")
    marked = join_spread(W, gone.withColumn("_gone", F.lit(True)), "role_id", "worker_id", "left")
    new_w = marked.withColumn(
        "role_id", F.when(F.col("_gone"), F.lit(None).cast("long")).otherwise(F.col("role_id")))
    return R.join(gone, "role_id", "left_anti"), conform(new_w, WORKERS), outcomes
