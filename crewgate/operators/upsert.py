"""Generic upsert by key.

Existing key: values replaced, ``updated_at`` = now, ``created_at`` kept.
New key: inserted with both stamps = now.  Of several updates of one key
the last by ``seq`` wins (``max_by``, partial aggregation).  One full outer
join on the key; both sides are unique per key, so no key can pile up.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.operators.sizing import join_spread, restrict_to


def upsert(updates: DataFrame, target: DataFrame, key: str, now: dt.datetime,
           seq: str = "seq") -> DataFrame:
    values = [c for c in updates.columns if c not in (key, seq)]
    latest = (updates.groupBy(key)
                     .agg(F.max_by(F.struct(*values), F.col(seq)).alias("_u"))
                     .withColumn("_hit", F.lit(True)))
    t = target.withColumn("_old", F.lit(True))
    j = t.join(latest, key, "full_outer")
    hit, old = F.col("_hit").isNotNull(), F.col("_old").isNotNull()
    now_col = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    out = []
    for c in target.columns:
        if c == key:
            out.append(F.col(key))
        elif c in values:
            out.append(F.when(hit, F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c))
        elif c == "created_at":
            out.append(F.when(old, F.col(c)).otherwise(now_col).alias(c))
        elif c == "updated_at":
            out.append(F.when(hit, now_col).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


# Outcome codes of upsert requests.
INSERTED, UPDATED, MISSING_KEY = "inserted", "updated", "missing_key"


def upsert_outcomes(updates: DataFrame, target: DataFrame, key: str,
                    seq: str = "seq") -> DataFrame:
    """seq, key, outcome of every request, applied in seq order: the first request of a
    key that is not stored inserts it, every other one updates; a NULL key is refused."""
    first = updates.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias("_first"))
    known = first.join(restrict_to(target, first, [key]).select(key, F.lit(True).alias("_old")),
                       key, "left")
    told = join_spread(updates.select(seq, key), known, key, seq, "left")
    return told.select(seq, key, F.when(F.col(key).isNull(), F.lit(MISSING_KEY))
                       .when(F.col("_old").isNull() & (F.col("_first") == F.col(seq)),
                             F.lit(INSERTED)).otherwise(F.lit(UPDATED)).alias("outcome"))
