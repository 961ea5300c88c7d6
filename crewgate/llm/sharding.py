"""Operator 8: shards of near-equal size by best-fit-decreasing bin packing.

Equal texts are one indivisible group.  Groups, largest first, enter the bin
with the tightest remaining capacity that holds them, found in a balanced
search tree of the remaining capacities.  The law is ``bytes``: the capacity
that the shards share is the smallest (to one part in 10^5) at which the groups
fit, so their sizes come out nearly equal.

Scale.  Packing has two levels.  Every partition packs its own groups into
cartons of 1 / (shards x CARTONS) of all bytes; a group above that is a carton
of its own.  Of two bins of one partition at most one is under half full, so
there are at most 2 x shards x CARTONS cartons and one per partition, whatever
the table holds; only these (a size and a row count each) are packed into
shards on the driver.  A row's place is the sum of its carton's place in the
shard, its group's in the carton, and its own in the group; the last one is
counted per input partition, so a group that holds a third of all rows is
split over the tasks that read it.

Edge cases.  A null text counts as empty (size 8) and groups with empty texts.
Null ids and repeated rows get a slot each.  An empty table gives no row;
fewer groups than shards leave shards empty.  A group larger than the mean
shard fills one by itself.  Other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewgate.llm.common import stored

SHARDS, CARTONS, OVERHEAD = 24, 1024, 8


class CapacityTree:
    """Remaining capacities as (capacity, bin) in a two-level B-tree.

    Leaves are sorted lists of at most ``FULL`` entries, split in halves when
    they outgrow it; the root holds the greatest entry of every leaf.
    """

    FULL = 512

    def __init__(self):
        self.leaves, self.tops = [], []

    def add(self, capacity: int, bin_: int) -> None:
        entry = (capacity, bin_)
        if not self.leaves:
            self.leaves, self.tops = [[entry]], [entry]
            return
        k = min(bisect_left(self.tops, entry), len(self.tops) - 1)
        leaf = self.leaves[k]
        insort(leaf, entry)
        if len(leaf) > self.FULL:
            half = len(leaf) // 2
            self.leaves[k:k + 1] = [leaf[:half], leaf[half:]]
            self.tops[k:k + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.tops[k] = leaf[-1]

    def take_tightest(self, size: int):
        """Remove and return the least (capacity, bin) with capacity >= size, or None."""
        k = bisect_left(self.tops, (size, -1))
        if k == len(self.tops):
            return None
        leaf = self.leaves[k]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[k] = leaf[-1]
        else:
            del self.leaves[k], self.tops[k]
        return entry


def best_fit(sizes, capacity: int, most: int | None = None):
    """Bin of every size (given in descending order); None if over ``most`` bins.

    A size above the capacity is a bin of its own.
    """
    tree, out, n = CapacityTree(), [], 0
    for size in sizes:
        got = tree.take_tightest(size)
        if got is None:
            got = (max(capacity, size), n)
            n += 1
            if most is not None and n > most:
                return None
        out.append(got[1])
        if got[0] > size:
            tree.add(got[0] - size, got[1])
    return out


def into_shards(sizes, shards: int):
    """Bin per size (descending) at the smallest capacity that needs ``shards`` bins."""
    if not len(sizes):
        return []
    low = max(-(-sum(sizes) // shards), sizes[0]) - 1
    step = max(1, (low + 1) // 100000)
    high, found = low + 1, None
    while found is None:                       # double the slack until it fits
        found = best_fit(sizes, high, shards)
        if found is None:
            low, high = high, high + max(step, 2 * (high - low))
    while high - low > step:
        mid = (low + high) // 2
        got = best_fit(sizes, mid, shards)
        if got is None:
            low = mid
        else:
            high, found = mid, got
    return found


def carton_packer(capacity: int):
    """Groups of one partition, largest first -> (key, carton, rows before it there)."""
    def run(batches):
        import pyarrow as pa

        base = TaskContext.get().partitionId() << 33
        tree, filled = CapacityTree(), []
        for batch in batches:
            keys = batch.column("key")
            cartons, before = [], []
            for size, rows in zip(batch.column("bytes").to_pylist(),
                                  batch.column("rows").to_pylist()):
                got = tree.take_tightest(size)
                if got is None:
                    got = (max(capacity, size), len(filled))
                    filled.append(0)
                if got[0] > size:
                    tree.add(got[0] - size, got[1])
                cartons.append(base + got[1])
                before.append(filled[got[1]])
                filled[got[1]] += rows
            yield pa.RecordBatch.from_pydict({
                "key": keys, "carton": pa.array(cartons, pa.int64()),
                "before": pa.array(before, pa.int64()), "bytes": batch.column("bytes"),
                "rows": batch.column("rows")})
    return run


def shard(documents: DataFrame, shards: int = SHARDS, cartons: int = CARTONS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row."""
    spark = documents.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows, _ = stored(documents.select(
        "doc_id", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("key"),
        F.spark_partition_id().alias("part")), "shard-rows")
    parts = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"),
                                            F.first("size").alias("size"))
    groups = parts.groupBy("key").agg(F.sum("n").alias("rows"),
                                      (F.sum("n") * F.first("size")).alias("bytes"))
    total = rows.agg(F.sum("size").alias("t")).first()["t"] or 0
    capacity = max(1, -(-total // (shards * cartons)))
    packed, _ = stored(groups.repartition("key").sortWithinPartitions(F.desc("bytes"), "key")
                       .mapInArrow(carton_packer(capacity),
                                   "key binary, carton long, before long, bytes long, rows long"),
                       "cartons")
    # bounded: at most 2 x shards x cartons rows and one per partition
    boxes = packed.groupBy("carton").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")) \
        .orderBy(F.desc("bytes"), "carton").collect()
    at, places = [0] * shards, []
    for box, s in zip(boxes, into_shards([b["bytes"] for b in boxes], shards)):
        places.append((box["carton"], s, at[s]))
        at[s] += box["rows"]
    places = F.broadcast(spark.createDataFrame(places, "carton long, shard int, base long"))

    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = parts.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    runs = runs.join(packed.select("key", "carton", "before"), "key").join(places, "carton").select(
        "key", "part", "shard", (F.col("base") + F.col("before") + F.col("ahead")).alias("first"))
    inside = Window.partitionBy("key", "part").orderBy("doc_id")
    numbered = rows.withColumn("k", F.row_number().over(inside))
    return numbered.join(runs, ["key", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("k") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
