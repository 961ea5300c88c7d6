"""Dense surrogate keys in a given order, without a one-partition window.

The rows are range-partitioned and sorted on the order columns; each row's
partition index and position inside its partition come from
``monotonically_increasing_id`` (partition index in the upper 31 bits, row
position in the lower 33).  Per-partition row counts — one row per partition,
so bounded by the partition count — give exclusive prefix offsets, which are
broadcast back.  The sorted frame is checkpointed to the shared checkpoint
folder first, so that the counts and the final ids see the very same
partitioning even if an executor is lost in between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewgate.session import ensure_checkpoint_dir

_POS_BITS = 33


def assign_ids(df: DataFrame, order: list, start: Column | int, id_col: str = "id",
               num_partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = start, start + 1, ... following ``order``.

    ``order`` must be a total order (end it with a unique column); ``start``
    may be a literal or a one-row-derived scalar column (e.g. max id + 1
    broadcast in by the caller).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    mid = F.monotonically_increasing_id()
    # without a given number, AQE sizes the partitions of the range exchange
    dealt = df.repartitionByRange(num_partitions, *order_cols) if num_partitions \
        else df.repartitionByRange(*order_cols)
    ranged = (dealt.sortWithinPartitions(*order_cols)
                .withColumn("_mid", mid))
    ranged = ranged.checkpoint(eager=True)
    ranged = ranged.withColumn("_part", F.shiftright("_mid", _POS_BITS)) \
                   .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    start_col = F.lit(start) if isinstance(start, int) else start
    return (ranged.join(F.broadcast(offsets), "_part")
                  .withColumn(id_col, (start_col + F.col("_offset") + F.col("_pos")).cast("long"))
                  .drop("_mid", "_part", "_pos", "_offset"))


def next_id(existing: DataFrame, id_col: str) -> int:
    """max(existing id) + 1, or 1 for an empty table (one scalar to the driver)."""
    top = existing.agg(F.max(id_col).alias("m")).first()["m"]
    return 1 if top is None else int(top) + 1


def assign_ids_after(df: DataFrame, existing: DataFrame, existing_id: str, order: list,
                     id_col: str) -> DataFrame:
    """Ids continuing after the largest id of ``existing`` (AUTO_INCREMENT)."""
    return assign_ids(df, order, next_id(existing, existing_id), id_col)
