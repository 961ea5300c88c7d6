"""Join helpers: semi-join reduction, and joins whose NULL keys do not pile up.

The batch's distinct keys filter the table, so that only rows that matter are
aggregated or joined later.  Which side is broadcast, if any, is left to the
planner's byte threshold and to AQE's runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def present_keys(big: DataFrame, probe: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct key tuples of ``probe`` that occur in ``big``."""
    return restrict_to(big.select(*keys), probe, keys).distinct()


def restrict_to(big: DataFrame, probe: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``big`` whose keys occur in ``probe``."""
    return big.join(probe.select(*keys).dropna().distinct(), keys, "left_semi")


def join_spread(df: DataFrame, right: DataFrame, key: str, spread: str, how: str) -> DataFrame:
    """Left outer or left anti join on ``key``.  A NULL key matches nothing; its rows
    are dealt by a hash of ``spread`` instead of meeting in one task."""
    salt = F.when(F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("long"))
    # 0 for every real key, in a form that is not folded out of the join condition
    zero = F.xxhash64(key) * F.lit(0).cast("long")
    return df.withColumn("_salt", salt).join(right.withColumn("_salt", zero), [key, "_salt"],
                                             how).drop("_salt")
