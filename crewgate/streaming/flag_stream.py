"""Flag changes as a continuous feed.

Same rules as the batch operator (``operators.flags``): records are parsed
and checked (value, type, field, actor), and the state keeps one value per
(type, id, field) — ``max_by(value, seq)`` — so a record arriving late cannot
overwrite a newer one and no watermark is needed (the state is bounded by
the number of entity fields, not by time).  There is no per-batch join with
the worker table: a change aimed at a missing id only leaves a state row
that joins no entity when the snapshot is built.

Each micro-batch writes its updated keys (with their seq) to a folder of its
own, ``batches/feed=<feed>/batch_id=<N>``, in overwrite mode: a batch replayed
after a failure rewrites the same folder.  ``feed`` names the checkpoint, so a
stream restarted with a new one cannot touch the folders of the old.  Readers
reduce all folders with ``max_by(value, seq)``, so the order and the number of
writes never matter.  ``compact`` writes the reduced rows of a feed's batches up
to one as ``bases/feed=<feed>/base_upto=<N>``, which stands for those batches
from the moment it is complete (Spark's ``_SUCCESS`` marker); batch numbers and
batch folders stay as they are.  The snapshot with the changes applied is
``flags.apply_latest(state_rows(...), W, C)``.

What became of every record is a second output, a stream of its own over the same
source: each micro-batch writes one row per record with its reason (NULL: passes
every test that needs no table) to ``outcomes/feed=<feed>/batch_id=<N>``, again
rewritten by a replay.  ``feed_outcomes`` reads them with one row per seq, however
many feeds have read a record, and adds whether the target is there, with one
semi join over all.  A feed that has written nothing yet reads as an empty table.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crewgate.operators import flags
from crewgate.sources.changes import CHANGE_RECORD

KEY = ["type", "id", "field"]
STATE = "type string, id long, field string, value int, seq long"
OUTCOME = ("seq long, actor string, type string, id long, field string, value int, "
           "reason string")
# Fixed value: micro-batches that a backlog is read in, at most.
BACKLOG_BATCHES = 8


def read_change_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """JSON-lines files of (seq, actor, change) as a stream."""
    return (spark.readStream.schema(CHANGE_RECORD)
                 .option("maxFilesPerTrigger", files_per_batch).json(path))


def files_per_batch(spark: SparkSession, path: str, batches: int = BACKLOG_BATCHES) -> int:
    """How many files a micro-batch must take for those now under ``path`` to be read in
    at most ``batches``.  A batch has a fixed cost (a commit of every state partition, a
    folder of its own), so their number must not grow with the backlog."""
    files = len(spark.read.schema(CHANGE_RECORD).json(path).inputFiles())
    return max(-(-files // batches), 1)


def feed_name(checkpoint: str) -> str:
    """The feed of a checkpoint folder."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def batch_writer(root: str, feed: str, output: str = "batches"):
    """The ``foreachBatch`` sink: one folder per batch, rewritten by a replay."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{output}/feed={feed}/batch_id={batch_id}")
    return write


def flag_state(changes: DataFrame, allowed_actors: list[str] | None = None) -> DataFrame:
    """The stateful part of the feed: last valid value and seq per
    (type, id, field).  No join: nothing here reads the entity tables."""
    checked = flags.checked_changes(changes, allowed_actors)
    return (checked.where(F.col("reason").isNull())
                   .groupBy(*KEY)
                   .agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")))


def start_flag_stream(changes: DataFrame, root: str, checkpoint: str,
                      allowed_actors: list[str] | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Start the feed; its batches go under ``root``, which ``latest_table`` reads."""
    state = flag_state(changes, allowed_actors).select(*KEY, "value", "seq")
    return _start(state, "update", root, "batches", checkpoint, available_now)


def start_outcome_stream(changes: DataFrame, root: str, checkpoint: str,
                         allowed_actors: list[str] | None = None,
                         available_now: bool = True) -> StreamingQuery:
    """Start the second output: a row per record under ``root``, which ``feed_outcomes``
    reads.  It keeps no state; ``checkpoint`` is its own, not the feed's."""
    return _start(flags.checked_changes(changes, allowed_actors), "append", root, "outcomes",
                  checkpoint, available_now)


def _start(rows: DataFrame, mode: str, root: str, output: str, checkpoint: str,
           available_now: bool) -> StreamingQuery:
    writer = (rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
                  .foreachBatch(batch_writer(root, feed_name(checkpoint), output)))
    writer = writer.trigger(availableNow=True) if available_now \
        else writer.trigger(processingTime="10 seconds")
    return writer.start()


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all feeds of a folder; none before the first batch is written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def feed_outcomes(spark: SparkSession, root: str, W: DataFrame, C: DataFrame) -> DataFrame:
    """What became of every record read so far: columns of ``flags.change_outcomes``."""
    rows = _read(spark, f"{root}/outcomes", f"{OUTCOME}, feed string, batch_id long") \
        .drop("feed", "batch_id")
    return flags.with_targets(rows.dropDuplicates(["seq"]), W, C)


def _complete_bases(spark: SparkSession, root: str) -> dict[str, int]:
    """Last complete base of every feed (a listing of folder names)."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/bases/feed=*/base_upto=*/_SUCCESS")
    fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last: dict[str, int] = {}
    for status in fs.globStatus(pattern) or []:
        feed, upto = re.search(r"/feed=([^/]+)/base_upto=(\d+)/", status.getPath().toString()).groups()
        last[feed] = max(int(upto), last.get(feed, -1))
    return last


def _parts(spark: SparkSession, root: str) -> DataFrame:
    """The state rows of all feeds: the last base of each and the batches after it."""
    rows = _read(spark, f"{root}/batches", f"{STATE}, feed string, batch_id long")
    bases = _complete_bases(spark, root)
    if not bases:
        return rows.select(*KEY, "value", "seq")
    done = F.create_map(*[F.lit(x) for item in bases.items() for x in item])
    after = rows.where(F.col("batch_id") > F.coalesce(done[F.col("feed")], F.lit(-1)))
    base = spark.read.schema(STATE).parquet(
        *[f"{root}/bases/feed={f}/base_upto={n}" for f, n in bases.items()])
    return after.select(*KEY, "value", "seq").unionByName(base.select(*KEY, "value", "seq"))


def _reduced(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max_by("value", "seq").alias("value"),
                                  F.max("seq").alias("seq"))


def latest_table(spark: SparkSession, root: str) -> DataFrame:
    """Last value and seq per (type, id, field) over every batch of every feed."""
    return _reduced(_parts(spark, root))


def state_rows(spark: SparkSession, root: str) -> DataFrame:
    """All written state rows, for ``flags.apply_latest``, which reduces them itself."""
    return _parts(spark, root)


def compact(spark: SparkSession, root: str, feed: str, upto: int) -> None:
    """Write the reduced rows of the feed's batches 0 to ``upto`` as one base.

    A base that readers may be listing is never replaced: ``upto`` must be above the
    last complete one (a base left unfinished by a failure is written anew).
    """
    rows = _read(spark, f"{root}/batches", f"{STATE}, feed string, batch_id long") \
        .where(F.col("feed") == feed)
    last = _complete_bases(spark, root).get(feed)
    if last is not None:
        if upto <= last:
            raise ValueError(f"batches up to {last} are compacted already")
        rows = rows.where(F.col("batch_id") > last)
    rows = rows.where(F.col("batch_id") <= upto).select(*KEY, "value", "seq")
    if last is not None:
        rows = rows.unionByName(spark.read.schema(STATE).parquet(
            f"{root}/bases/feed={feed}/base_upto={last}"))
    _reduced(rows).write.mode("overwrite").parquet(f"{root}/bases/feed={feed}/base_upto={upto}")
