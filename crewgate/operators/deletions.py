"""Deletions by id, one request after the other.

The first request (by seq) that names a stored id deletes it; a later one, one that
names an unknown id and one without an id find nothing.  The requests reduce to one
row per id map-side before they meet the table, so an id that a third of the
requests name is one row there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.operators.sizing import join_spread

# Outcome codes of deletions.
DELETED, NOT_FOUND = "deleted", "not_found"


def split_requests(requests: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(ids that go as ``key``, outcomes: seq, id, outcome) of ``requests`` (seq, id)."""
    asked = requests.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("seq").alias("_first"))
    gone = asked.join(table.select(F.col(key).alias("id")), "id", "left_semi")
    outcomes = join_spread(requests.select("seq", "id"), gone, "id", "seq", "left").select(
        "seq", "id", F.when(F.col("_first") == F.col("seq"), F.lit(DELETED))
        .otherwise(F.lit(NOT_FOUND)).alias("outcome"))
    return gone.select(F.col("id").alias(key)), outcomes
