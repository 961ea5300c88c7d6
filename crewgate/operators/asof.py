"""As-of join: the last event before each probe on the same key.

Probes and events are dealt by ranges of (key, seq) and sorted, so a key that holds
a third of all rows spreads over as many tasks as its share.  Inside a partition a
running "last event" does the work; what a partition hands to the next one is its
last event, one row per partition (bounded by the partition count, so it is
broadcast), needed by the probes that precede the partition's first event alone.
The sorted rows are checkpointed first, so both passes see the same partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewgate.session import ensure_checkpoint_dir


def last_before(probes: DataFrame, events: DataFrame, key: str, seq: str,
                value: str) -> DataFrame:
    """``probes`` with ``value`` of the event of the same ``key`` with the largest
    ``seq`` below the probe's own; NULL where there is none or the key is NULL.

    Events have unique (key, seq); columns of ``events`` beside the three are not used.
    """
    ensure_checkpoint_dir(probes.sparkSession)
    event = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    e = events.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(seq).alias("_seq"), F.lit(1).alias("_is_event"),
        event.alias("_event"))
    p = probes.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"),
                      F.lit(0).alias("_is_event"), F.struct("*").alias("_row"))
    # a probe precedes an event of its own seq: "before" is strict
    order = ["_key", "_seq", "_is_event"]
    placed = p.unionByName(e, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order) \
        .withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True) \
        .withColumn("_part", F.shiftright("_id", 33))
    running = Window.partitionBy("_part").orderBy("_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    seen = placed.withColumn("_last", F.last("_event", ignorenulls=True).over(running))
    ends = placed.groupBy("_part").agg(F.max_by(
        "_event", F.when(F.col("_event").isNotNull(), F.col("_id"))).alias("_end"))
    before = ends.select("_part", F.last("_end", ignorenulls=True).over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    found = F.coalesce("_last", "_carried")
    out = seen.where("_is_event = 0").join(F.broadcast(before), "_part", "left")
    return out.select("_row.*", F.when(found["k"] == F.col("_key"), found["v"]).alias(value))


def running_max(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the largest ``value`` of the rows of the same ``key`` with a
    smaller ``order`` (NULL where there is none).  (key, order) is unique, key not NULL.

    Dealt by ranges like ``last_before``; what a partition hands on is the maximum of
    its last key so far, one row per partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.repartitionByRange(key, order).sortWithinPartitions(key, order) \
        .withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True) \
        .withColumn("_part", F.shiftright("_id", 33))
    inside = Window.partitionBy("_part", key).orderBy("_id").rowsBetween(
        Window.unboundedPreceding, -1)
    tops = placed.groupBy("_part", key).agg(F.max(value).alias("_top"))
    ends = placed.groupBy("_part").agg(F.max_by(key, "_id").alias(key))
    firsts = placed.groupBy("_part").agg(F.min_by(key, "_id").alias(key))
    # at most two rows per partition
    handed = tops.join(F.broadcast(ends), ["_part", key]).unionByName(
        firsts.withColumn("_top", F.lit(None).cast(df.schema[value].dataType)))
    carried = handed.groupBy("_part", key).agg(F.max("_top").alias("_top")).withColumn(
        "_carried", F.max("_top").over(Window.partitionBy(key).orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1))).drop("_top")
    return placed.withColumn(name, F.max(value).over(inside)) \
        .join(F.broadcast(carried), ["_part", key], "left") \
        .withColumn(name, F.greatest(name, "_carried")).select(*df.columns, name)
