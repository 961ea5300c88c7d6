"""D1 D2 D6 in one log: additions and deletions of companies and workers applied in
their order of arrival.

A log row is (seq, op, ...) with the columns of the single operators; ``op`` is
add_company, add_worker, delete_company or delete_worker.  The result is that of
applying the rows one at a time: a worker may join a company that an earlier row
added, a name is free again once its company is deleted, a deleted company takes
along workers that earlier rows gave it.  Ids are given in seq order after the
largest stored one; a deletion names an id stored before the log, as the ids of
new rows are only known after it.

No row waits for another's result but the first-come rules.  Every entity has a
lifetime over seq: stored ones live until their first deletion, known at once; a
worker's ends with its company's at the latest.  So

* a stored key blocks requests up to the latest death among its holders, one
  aggregate per key;
* the company that a name stands for at a seq is found by an as-of join with the
  intervals in which each company is the lowest living id of that name
  (``asof.running_max`` over the deaths of lower ids, then ``asof.last_before``);
* within the log, D1's first-come rule (``greedy.first_by_keys``) and the lowest seq
  per worker key decide, since nothing that the log adds loses its key again.

No window is partitioned by a name, key or id, so none of them can be hot.

Edge cases.  Rows with another op are ``unknown_op``; ids that are NULL, unknown or
gone are ``not_found``.  The log is checkpointed once; building the result runs jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.functions import exprs as X
from crewgate.operators import asof, quality, workers
from crewgate.operators.companies import ACCEPTED, DUPLICATE, EXISTS, TEXT_FIELDS
from crewgate.operators.deletions import DELETED, NOT_FOUND
from crewgate.operators.greedy import first_by_keys
from crewgate.operators.keys import assign_ids_after
from crewgate.operators.sizing import join_spread, restrict_to
from crewgate.schema import COMPANIES, WORKERS, conform
from crewgate.session import ensure_checkpoint_dir

# The operations of a log, and the outcome of any other.
ADD_COMPANY, ADD_WORKER, DELETE_COMPANY, DELETE_WORKER = (
    "add_company", "add_worker", "delete_company", "delete_worker")
UNKNOWN_OP = "unknown_op"
FIRST, NEVER = -(1 << 63), (1 << 63) - 1         # before and after every seq


def _first_deletions(log: DataFrame, op: str, key: str, name: str) -> DataFrame:
    """(key, name): the first deletion of every id that the log names."""
    return log.where((F.col("op") == op) & F.col("id").isNotNull()).groupBy(
        F.col("id").alias(key)).agg(F.min("seq").alias(name))


def _add_companies(log: DataFrame, C: DataFrame, died: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new companies with seq, outcomes) of the log's additions.  ``died``: company_id,
    c_died."""
    cand = quality.with_candidate_keys(log.where(F.col("op") == ADD_COMPANY).select(
        "seq", *[X.blank_if_null(c).alias(c) for c in TEXT_FIELDS])).checkpoint(eager=True)
    stored = C.join(died, "company_id", "left").select(
        X.name_key("company_name").alias("_nk"), X.stored_vat_key("vat_number").alias("_vk"),
        F.coalesce("c_died", F.lit(NEVER)).alias("_until"))
    checked = cand.select("seq", "_nk", "_vk")
    for k in ("_nk", "_vk"):
        until = restrict_to(stored, checked, [k]).groupBy(k).agg(
            F.max("_until").alias(f"_until{k}"))
        checked = join_spread(checked, until, k, "seq", "left")
    exists = F.coalesce(F.greatest("_until_nk", "_until_vk") > F.col("seq"), F.lit(False))
    checked = checked.select("seq", "_nk", "_vk", exists.alias("_exists")).checkpoint(eager=True)
    winners = first_by_keys(checked.where("NOT _exists").select("seq", "_nk", "_vk"),
                            ["_nk", "_vk"], "seq").select("seq")
    new = assign_ids_after(cand.join(winners, "seq", "left_semi").drop("_nk", "_vk"), C,
                           "company_id", ["seq"], "company_id").checkpoint(eager=True)
    told = checked.join(new.select("seq", "company_id"), "seq", "left").select(
        "seq", F.when(F.col("_exists"), F.lit(EXISTS))
        .when(F.col("company_id").isNull(), F.lit(DUPLICATE)).otherwise(F.lit(ACCEPTED))
        .alias("outcome"), "company_id", F.lit(None).cast("long").alias("worker_id"))
    return new, told


def name_events(names: DataFrame, died: DataFrame, new: DataFrame) -> DataFrame:
    """(name, at, company_id): from ``at`` on, the name stands for that company (NULL:
    for none) - the lowest id among its living holders.

    ``names``: company_id, name of stored companies; ``died``: company_id, c_died;
    ``new``: seq, company_id, name of companies that the log adds.
    """
    lives = names.join(died, "company_id", "left_anti").groupBy("name").agg(
        F.min("company_id").alias("_lowest"))
    dying = names.join(died, "company_id").join(lives, "name", "left").where(
        F.col("_lowest").isNull() | (F.col("company_id") < F.col("_lowest"))) \
        .select("name", "company_id", "c_died")
    turns = asof.running_max(dying, "name", "company_id", "c_died", "_before")
    own = turns.where(F.col("_before").isNull() | (F.col("_before") < F.col("c_died"))).select(
        "name", F.coalesce("_before", F.lit(FIRST)).alias("at"), "company_id")
    last = dying.groupBy("name").agg(F.max("c_died").alias("at"))
    after = last.join(lives, "name", "full_outer").select(
        "name", F.coalesce("at", F.lit(FIRST)).alias("at"), F.col("_lowest").alias("company_id"))
    return own.unionByName(after).unionByName(
        new.select("name", F.col("seq").alias("at"), "company_id"))


def _add_workers(log: DataFrame, W: DataFrame, C: DataFrame, died: DataFrame, new: DataFrame,
                 w_asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new workers with seq, outcomes) of the log's additions."""
    fold = X.fold("company_name", None)
    cand = log.where(F.col("op") == ADD_WORKER).drop("op", "id").withColumn("name", fold)
    names = restrict_to(C.select("company_id", fold.alias("name")), cand, ["name"])
    events = name_events(names, died, new.select("seq", "company_id", fold.alias("name")))
    placed = asof.last_before(cand.withColumn("at", F.col("seq")), events, "name", "at",
                              "company_id")
    r = workers.with_early(workers.with_checks(placed.drop("at", "name"))).checkpoint(eager=True)
    key = list(quality.WORKER_KEY)
    held = restrict_to(W.select("worker_id", *quality.worker_key_cols(), "company_id"), r, key)
    until = held.join(w_asked, "worker_id", "left").join(died, "company_id", "left") \
        .withColumn("_until", F.coalesce(F.least("w_asked", "c_died"), F.lit(NEVER))) \
        .groupBy(*key).agg(F.max("_until").alias("_until"))
    blocked = F.coalesce(F.col("_until") > F.col("seq"), F.lit(False))
    r = r.join(until, key, "left").withColumn("_blocked", blocked).checkpoint(eager=True)
    first = r.where(F.col("_early").isNull() & ~F.col("_temp_no_date") & ~F.col("_blocked")) \
        .dropna(subset=key).groupBy(*key).agg(F.min("seq").alias("_first"))
    reason = F.coalesce(
        F.col("_early"),
        F.when(F.col("_blocked") | (F.col("_first") < F.col("seq")), F.lit(workers.DUPLICATE)),
        F.when(F.col("_temp_no_date"), F.lit(workers.TEMP_NO_DATE)))
    r = r.join(first, key, "left").withColumn("_reason", reason).checkpoint(eager=True)
    added = assign_ids_after(workers.accepted_rows(r), W, "worker_id", ["seq"], "worker_id") \
        .checkpoint(eager=True)
    told = added.select("seq", F.lit(ACCEPTED).alias("outcome"), "company_id",
                        "worker_id").unionByName(
        r.where(F.col("_reason").isNotNull()).select(
            "seq", F.col("_reason").alias("outcome"), "company_id",
            F.lit(None).cast("long").alias("worker_id")))
    return added, told


def apply_log(log: DataFrame, W: DataFrame,
              C: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(companies, workers, outcomes) after all rows of ``log``; outcomes: seq, op,
    outcome, company_id, worker_id."""
    ensure_checkpoint_dir(log.sparkSession)
    log = log.checkpoint(eager=True)
    c_asked = _first_deletions(log, DELETE_COMPANY, "company_id", "c_died")
    died = c_asked.join(C.select("company_id"), "company_id", "left_semi").checkpoint(eager=True)
    w_asked = _first_deletions(log, DELETE_WORKER, "worker_id", "w_asked").checkpoint(eager=True)
    new, company_told = _add_companies(log, C, died)
    added, worker_told = _add_workers(log, W, C, died, new, w_asked)

    none = F.lit(None).cast("long")
    asked = log.where(F.col("op") == DELETE_COMPANY).select("seq", F.col("id").alias("company_id"))
    company_gone = join_spread(asked, died, "company_id", "seq", "left").select(
        "seq", F.when(F.col("c_died") == F.col("seq"), F.lit(DELETED)).otherwise(F.lit(NOT_FOUND))
        .alias("outcome"), "company_id", none.alias("worker_id"))
    # the stored workers that the log names, and when their company takes them along
    named = join_spread(W.join(w_asked, "worker_id").select("worker_id", "company_id", "w_asked"),
                        died, "company_id", "worker_id", "left")
    hit = named.where(F.col("c_died").isNull() | (F.col("c_died") > F.col("w_asked"))) \
        .select("worker_id", "w_asked")
    asked = log.where(F.col("op") == DELETE_WORKER).select("seq", F.col("id").alias("worker_id"))
    worker_gone = join_spread(asked, hit, "worker_id", "seq", "left").select(
        "seq", F.when(F.col("w_asked") == F.col("seq"), F.lit(DELETED)).otherwise(F.lit(NOT_FOUND))
        .alias("outcome"), none.alias("company_id"), "worker_id")
    known = [ADD_COMPANY, ADD_WORKER, DELETE_COMPANY, DELETE_WORKER]
    odd = log.where(~F.coalesce(F.col("op").isin(*known), F.lit(False))).select(
        "seq", F.lit(UNKNOWN_OP).alias("outcome"), none.alias("company_id"), none.alias("worker_id"))
    told = reduce(DataFrame.unionByName, [company_told, worker_told, company_gone, worker_gone, odd])
    outcomes = log.select("seq", "op").join(told, "seq")

    new_c = C.join(died, "company_id", "left_anti").unionByName(
        conform(new.withColumn("is_sole_trader", F.lit(0)), COMPANIES))
    stay = added.join(died, "company_id", "left").where(
        F.col("c_died").isNull() | (F.col("c_died") < F.col("seq")))
    new_w = W.join(died, "company_id", "left_anti").join(w_asked, "worker_id", "left_anti") \
        .unionByName(conform(stay, WORKERS))
    return new_c, new_w.select(W.columns), outcomes
