"""Chains of decisions by pointer doubling.

A row whose verdict depends on one other row's points at it.  Following the
pointers one by one takes as many rounds as the longest chain has links; here
every row's pointer jumps to where its target points in each step, so a chain of n
links takes about log2(n) steps, each one join and one checkpoint in the shared
checkpoint folder.  Pointers must not form a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewgate.session import ensure_checkpoint_dir


def settle(nodes: DataFrame, stats: dict | None = None) -> DataFrame:
    """(id, verdict) of every row of ``nodes``.

    ``nodes``: id (unique), ptr (an id of ``nodes``, or NULL), verdict (boolean, for
    rows without ptr; NULL is "not known"), if_yes and if_no (the row's verdict when
    its target's is true, or false).  A row that leads to an unknown verdict keeps
    NULL.  ``stats["rounds"]`` is raised by the number of steps.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    n = nodes.select("id", "ptr", "verdict", "if_yes", "if_no").checkpoint(eager=True)
    return n.where(F.col("ptr").isNull()).select("id", "verdict") \
        .unionByName(followed(n, stats))


def followed(nodes: DataFrame, stats: dict | None = None) -> DataFrame:
    """(id, verdict) of the rows of ``nodes`` that have a pointer, as ``settle`` gives them.

    ``nodes`` is read more than once, so it should be stored.  Only the rows with a
    pointer and the ones at which their chains end (the last link of a chain points at
    its end) go through the steps; the others are never moved.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    open_ = nodes.where(F.col("ptr").isNotNull())
    ends = nodes.where(F.col("ptr").isNull()).join(
        open_.select(F.col("ptr").alias("id")).distinct(), "id", "left_semi")
    columns = ["id", "ptr", "verdict", "if_yes", "if_no"]
    n = open_.select(*columns, F.lit(True).alias("_open")).unionByName(
        ends.select(*columns, F.lit(False).alias("_open"))).checkpoint(eager=True)
    while not n.where(F.col("ptr").isNotNull()).isEmpty():
        at = n.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"),
                      F.col("verdict").alias("_verdict"), F.col("if_yes").alias("_yes"),
                      F.col("if_no").alias("_no"))
        yes, no = F.col("if_yes"), F.col("if_no")
        jumped = n.where(F.col("ptr").isNotNull()).join(at, "ptr").select(
            "id", F.col("_ptr").alias("ptr"),
            F.when(F.col("_verdict"), yes).when(~F.col("_verdict"), no).alias("verdict"),
            F.when(F.col("_yes"), yes).otherwise(no).alias("if_yes"),
            F.when(F.col("_no"), yes).otherwise(no).alias("if_no"), "_open")
        n = n.where(F.col("ptr").isNull()).unionByName(jumped).checkpoint(eager=True)
        if stats is not None:
            stats["rounds"] = stats.get("rounds", 0) + 1
    return n.where("_open").select("id", "verdict")


def roots(nodes: DataFrame) -> DataFrame:
    """(id, root): where every row's pointers end.  ``nodes``: id (unique), ptr (or NULL)."""
    ensure_checkpoint_dir(nodes.sparkSession)
    n = nodes.select("id", "ptr", F.when(F.col("ptr").isNull(), F.col("id")).alias("root")) \
        .checkpoint(eager=True)
    while not n.where(F.col("root").isNull()).isEmpty():
        at = n.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"),
                      F.col("root").alias("_root"))
        jumped = n.where(F.col("root").isNull()).join(at, "ptr").select(
            "id", F.col("_ptr").alias("ptr"), F.col("_root").alias("root"))
        n = n.where(F.col("root").isNotNull()).unionByName(jumped).checkpoint(eager=True)
    return n.select("id", "root")
