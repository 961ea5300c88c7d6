"""Company changes: add (D1), edit (D4), delete with cascade.

Every operator returns new frames plus ``outcomes`` — one row per request
with its reason — and never updates in place; ``sources.tables`` writes the
new snapshot as a new version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.functions import exprs as X
from crewgate.operators import quality
from crewgate.operators.deletions import split_requests
from crewgate.operators.greedy import first_by_keys
from crewgate.operators.keys import assign_ids_after
from crewgate.schema import COMPANIES, conform
from crewgate.session import ensure_checkpoint_dir

# Outcome codes of company requests.
ACCEPTED, EXISTS, DUPLICATE, NOT_FOUND, APPLIED = (
    "accepted", "exists", "duplicate", "not_found", "applied")

TEXT_FIELDS = ("company_name", "vat_number", "contact_name", "contact_email",
               "contact_phone", "note")


def add_companies(cand: DataFrame, C: DataFrame,
                  collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate and add new companies.

    ``cand`` has ``seq`` (arrival order, unique) and the six text fields.
    A request is rejected as ``exists`` when a stored company has its name
    key or (non-blank) VAT key, and as ``duplicate`` when an earlier accepted
    request of the batch has one of them.  Accepted rows get ids after the
    largest stored id, in seq order; the VAT is stored as typed, blanks and
    missing fields as ''.  ``collation`` (e.g. UNICODE_CI_AI) makes the name
    key accent-insensitive as well.
    """
    cand = cand.select("seq", *[X.blank_if_null(c).alias(c) for c in TEXT_FIELDS])
    fresh = quality.new_companies(cand, C, collation)
    # the requests not stored yet feed the in-batch rule and the outcomes:
    # checked against the stored keys once, kept in the checkpoint folder
    ensure_checkpoint_dir(cand.sparkSession)
    keyed = quality.with_candidate_keys(fresh, collation).select(
        "seq", "_nk", "_vk").checkpoint(eager=True)
    winners = first_by_keys(keyed, ["_nk", "_vk"], "seq").select("seq")
    accepted = assign_ids_after(cand.join(winners, "seq", "left_semi"), C, "company_id",
                                ["seq"], "company_id")
    new_rows = conform(accepted.withColumn("is_sole_trader", F.lit(0)), COMPANIES)
    outcomes = (cand.select("seq")
                .join(keyed.select("seq", F.lit(True).alias("_fresh")), "seq", "left")
                .join(accepted.select("seq", "company_id"), "seq", "left")
                .select("seq",
                        F.when(F.col("company_id").isNotNull(), F.lit(ACCEPTED))
                         .when(F.col("_fresh"), F.lit(DUPLICATE))
                         .otherwise(F.lit(EXISTS)).alias("outcome"),
                        "company_id"))
    return C.unionByName(new_rows), outcomes


def edit_companies(edits: DataFrame, C: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overwrite the six text fields of existing companies; the sole-
    trader flag is kept; no duplicate check.  Of several edits of one
    company the last by seq wins; an edit of an unknown id changes nothing."""
    found = edits.join(C.select("company_id"), "company_id", "left_semi")
    latest = (found.groupBy("company_id")
                   .agg(F.max_by(F.struct(*TEXT_FIELDS), F.col("seq")).alias("_new"),
                        F.max("seq").alias("_seq")))
    joined = C.join(latest, "company_id", "left")
    edited = F.col("_seq").isNotNull()
    new_c = joined.select(
        "company_id",
        *[F.when(edited, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in TEXT_FIELDS],
        "is_sole_trader")
    outcomes = edits.select("seq", "company_id").join(
        C.select("company_id", F.lit(True).alias("_found")), "company_id", "left").select(
        "seq", "company_id",
        F.when(F.col("_found"), F.lit(APPLIED)).otherwise(F.lit(NOT_FOUND)).alias("outcome"))
    return conform(new_c, COMPANIES), outcomes


def delete_companies(requests: DataFrame, C: DataFrame,
                     W: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove companies by id and, by cascade, their workers.  ``requests``: seq, id.  Returns (companies, workers, outcomes)."""
    gone, outcomes = split_requests(requests, C, "company_id")
    return (C.join(gone, "company_id", "left_anti"), W.join(gone, "company_id", "left_anti"),
            outcomes)
