"""Data quality: existence checks, orphans, duplicate keys, conformance.

(J5-J8, A9, Q1, Q2.)  Right-hand key sets are reduced with ``distinct``
(partial aggregation) before a semi/anti join, so a key repeated many times
on the reference side cannot pile up in one task; a hot key on the left side
is split by AQE's skew-join rule (it covers left semi/anti joins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewgate.functions import exprs as X
from crewgate.operators.sizing import join_spread, present_keys


# J5 -------------------------------------------------------------------------
def company_keys(C: DataFrame, collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct name keys and non-blank VAT keys of the stored companies."""
    names = C.select(X.name_key("company_name", collation).alias("_nk")) \
             .where(F.col("_nk").isNotNull()) \
             .distinct()
    vats = C.select(X.stored_vat_key("vat_number").alias("_vk")).where(F.col("_vk").isNotNull()) \
            .distinct()
    return names, vats


def with_candidate_keys(cand: DataFrame, collation: str | None = None) -> DataFrame:
    return cand.withColumn("_nk", X.name_key("company_name", collation)) \
               .withColumn("_vk", X.typed_vat_key("vat_number"))


def new_companies(cand: DataFrame, C: DataFrame, collation: str | None = None) -> DataFrame:
    """Candidates with no stored company of the same name key or, when the
    candidate has one, the same VAT key.

    ``name = x OR vat = y`` as one join condition plans as a nested loop;
    two successive anti joins give the same rows with two hash joins.
    """
    names, vats = company_keys(C, collation)
    keyed = with_candidate_keys(cand, collation)
    fresh = join_spread(keyed, names, "_nk", "seq", "left_anti")
    return join_spread(fresh, vats, "_vk", "seq", "left_anti").drop("_nk", "_vk")


def existing_companies(cand: DataFrame, C: DataFrame,
                       collation: str | None = None) -> DataFrame:
    """Candidates that match a stored company (the complement of new_companies)."""
    names, vats = company_keys(C, collation)
    keyed = with_candidate_keys(cand, collation)
    by_name = keyed.join(names, "_nk", "left_semi")
    by_vat = join_spread(keyed, names, "_nk", "seq", "left_anti").join(vats, "_vk", "left_semi")
    return by_name.unionByName(by_vat).drop("_nk", "_vk")


# J6 -------------------------------------------------------------------------
WORKER_KEY = ("_gk", "_sk", "company_id")


def worker_key_cols(given="given_name", surname="surname", collation: str | None = None):
    return [X.fold(given, collation).alias("_gk"), X.fold(surname, collation).alias("_sk")]


def stored_matches(keyed: DataFrame, W: DataFrame, collation: str | None = None) -> DataFrame:
    """Worker keys of ``keyed`` (which has _gk, _sk, company_id) that a stored
    worker holds; W is filtered against the batch's keys, not shuffled whole."""
    return present_keys(W.select(*worker_key_cols(collation=collation), "company_id"), keyed,
                        list(WORKER_KEY))


def existing_workers(cand: DataFrame, W: DataFrame, collation: str | None = None) -> DataFrame:
    """Candidates (with a resolved ``company_id``) equal to a stored worker on
    lower(given name), lower(surname), company; NULL never matches."""
    keyed = cand.select("*", *worker_key_cols(collation=collation))
    return keyed.join(stored_matches(keyed, W, collation), list(WORKER_KEY), "left_semi") \
                .drop("_gk", "_sk")


# J7 -------------------------------------------------------------------------
def missing_targets(changes: DataFrame, entities: DataFrame, key: str,
                    entity_key: str | None = None) -> DataFrame:
    """Change rows whose target id is not in ``entities``."""
    found = present_keys(entities.select(F.col(entity_key or key).alias(key)), changes, [key])
    return changes.join(found, key, "left_anti")


# J8 -------------------------------------------------------------------------
def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str, child_key: str) -> DataFrame:
    """Child rows whose non-NULL foreign key has no parent row."""
    parents = parent.select(F.col(pk).alias(fk)).distinct()
    return (child.where(F.col(fk).isNotNull()).join(parents, fk, "left_anti")
                 .select(F.col(child_key), F.lit(fk).alias("fk_column"),
                         F.col(fk).alias("fk_value")))


def worker_orphans(W: DataFrame, C: DataFrame, R: DataFrame) -> DataFrame:
    return (orphans(W, C, "company_id", "company_id", "worker_id")
            .unionByName(orphans(W, R, "role_id", "role_id", "worker_id")))


# A9 -------------------------------------------------------------------------
def duplicate_keys(df: DataFrame, keys: list) -> DataFrame:
    """Key values held by more than one row, with their row count."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))
    # NULL keys never collide (UNIQUE admits any number of NULLs)
    named = [c for c in counted.columns if c != "n_rows"]
    keep = F.col("n_rows") > 1
    for c in named:
        keep = keep & F.col(c).isNotNull()
    return counted.where(keep)


# Q1 -------------------------------------------------------------------------
def conformance_rejects(df: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """One row per (row, column) that breaks the schema: text longer than its
    ``max_length``, NULL in a NOT NULL column, or text that does not cast to
    the column's type.  Columns of ``schema`` absent from ``df`` are skipped."""
    checks = []
    for f in schema.fields:
        if f.name not in df.columns or f.name == key:
            continue
        c = F.col(f.name)
        if not f.nullable:
            checks.append(F.when(c.isNull(), _violation(f.name, "null", F.lit(None))))
        limit = f.metadata.get("max_length")
        if limit and isinstance(f.dataType, T.StringType):
            checks.append(F.when(F.length(c) > limit,
                                 _violation(f.name, "too_long", F.length(c))))
        if not isinstance(f.dataType, T.StringType) and \
                isinstance(df.schema[f.name].dataType, T.StringType):
            checks.append(F.when(c.isNotNull() & (c != "") & c.try_cast(f.dataType).isNull(),
                                 _violation(f.name, "bad_type", F.lit(None))))
    found = F.filter(F.array(*checks), lambda v: v.isNotNull())
    return df.select(F.col(key), F.explode(found).alias("v")) \
             .select(key, "v.column", "v.reason", "v.length")


def _violation(column: str, reason: str, length):
    return F.struct(F.lit(column).alias("column"), F.lit(reason).alias("reason"),
                    length.cast("int").alias("length"))


# Q2 -------------------------------------------------------------------------
def temporary_without_date(is_temporary, expiry_date):
    return (F.col(is_temporary) == 1) & F.col(expiry_date).isNull()
