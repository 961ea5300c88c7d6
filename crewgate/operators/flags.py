"""Apply flag changes (type, id, field, clicked) — absolute values, the
last valid change per (entity, field) by seq wins.

Plan: parse -> reason chain -> one aggregate per entity, ``max_by(value, seq)``
filtered by field, for every known field (partial aggregation: a worker clicked
a million times is reduced map-side) -> left join to the snapshot and
``coalesce``.  One exchange before the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.functions import exprs as X
from crewgate.operators.sizing import present_keys
from crewgate.schema import COMPANIES, COMPANY_FLAGS, FLAG_FIELDS, WORKER_FLAGS, WORKERS, conform
from crewgate.sources.changes import parse_changes

# Reasons, in the order they are tested.
MISSING_CLICKED = "missing_clicked"
BAD_VALUE = "bad_value"
MISSING_FIELDS = "missing_fields"
UNKNOWN_TYPE = "unknown_type"
UNKNOWN_FIELD = "unknown_field"
FORBIDDEN = "forbidden"
NOT_FOUND = "not_found"
APPLIED = "applied"
# Fixed value: the field only named actors may change.
RESTRICTED_FIELD = "badge_issued"


def checked_changes(changes: DataFrame, allowed_actors: list[str] | None = None) -> DataFrame:
    """Parsed changes with every reason except "not found" (NULL = passes)."""
    p = parse_changes(changes, "change") if "change" in changes.columns else changes
    if "actor" not in p.columns:
        p = p.withColumn("actor", F.lit(None).cast("string"))
    value = X.flag_value("clicked")
    known_field = reduce(lambda a, b: a | b,
                         [(F.col("type") == t) & F.col("field").isin(*fs)
                          for t, fs in FLAG_FIELDS.items()])
    reason = (F.when(~F.col("has_clicked"), F.lit(MISSING_CLICKED))
               .when(value.isNull(), F.lit(BAD_VALUE))
               .when(F.coalesce(F.col("type"), F.lit("")) == "", F.lit(MISSING_FIELDS))
               .when(F.col("id").isNull(), F.lit(MISSING_FIELDS))
               .when(~F.col("type").isin(*FLAG_FIELDS), F.lit(UNKNOWN_TYPE))
               .when(~F.coalesce(known_field, F.lit(False)), F.lit(UNKNOWN_FIELD)))
    if allowed_actors is not None:
        reason = reason.when((F.col("field") == RESTRICTED_FIELD)
                             & ~F.coalesce(F.col("actor").isin(*allowed_actors), F.lit(False)),
                             F.lit(FORBIDDEN))
    return p.select("seq", "actor", "type", "id", "field", value.alias("value"),
                    reason.alias("reason"))


def change_outcomes(changes: DataFrame, W: DataFrame, C: DataFrame,
                    allowed_actors: list[str] | None = None) -> DataFrame:
    """One row per change: seq, actor, type, id, field, value, reason."""
    return with_targets(checked_changes(changes, allowed_actors), W, C)


def with_targets(p: DataFrame, W: DataFrame, C: DataFrame) -> DataFrame:
    """Rows of ``checked_changes`` with the last reason: the entity is there or not."""
    entities = (W.select(F.lit("worker").alias("type"), F.col("worker_id").alias("id"))
                .unionByName(C.select(F.lit("company").alias("type"),
                                      F.col("company_id").alias("id"))))
    targets = present_keys(entities, p, ["type", "id"]).withColumn("_found", F.lit(True))
    p = p.join(targets, ["type", "id"], "left")
    reason = F.coalesce(F.col("reason"),
                        F.when(F.col("_found").isNull(), F.lit(NOT_FOUND)),
                        F.lit(APPLIED))
    return p.select("seq", "actor", "type", "id", "field", "value", reason.alias("reason"))


def _apply(snapshot: DataFrame, changes: DataFrame, etype: str, key: str,
           fields: tuple) -> DataFrame:
    """``snapshot`` with the last value by seq of every (id, field) of ``changes``
    (type, id, field, value, seq)."""
    last = [F.expr(f"max_by(value, seq) FILTER (WHERE field = '{f}')").alias(f"_new_{f}")
            for f in fields]
    wide = changes.where((F.col("type") == etype) & F.col("field").isin(*fields)) \
        .groupBy(F.col("id").alias(key)).agg(*last)
    joined = snapshot.join(wide, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c)
                           if c in fields else F.col(c) for c in snapshot.columns])


def apply_flag_changes(changes: DataFrame, W: DataFrame, C: DataFrame,
                       allowed_actors: list[str] | None = None, with_outcomes: bool = True
                       ) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Returns (new workers, new companies, outcomes).

    The snapshots need no "not found" check: a change aimed at a missing id
    joins no row and shares its (type, id, field) key with no change to an
    existing one.  ``with_outcomes=False`` skips building the outcomes.
    """
    valid = checked_changes(changes, allowed_actors).where(F.col("reason").isNull())
    outcomes = change_outcomes(changes, W, C, allowed_actors) if with_outcomes else None
    new_w = _apply(W, valid, "worker", "worker_id", WORKER_FLAGS)
    new_c = _apply(C, valid, "company", "company_id", COMPANY_FLAGS)
    return conform(new_w, WORKERS), conform(new_c, COMPANIES), outcomes


def apply_latest(latest: DataFrame, W: DataFrame, C: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply state rows (type, id, field, value, seq) of the stream, reduced or not."""
    return (conform(_apply(W, latest, "worker", "worker_id", WORKER_FLAGS), WORKERS),
            conform(_apply(C, latest, "company", "company_id", COMPANY_FLAGS), COMPANIES))
