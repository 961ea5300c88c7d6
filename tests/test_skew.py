"""One company / one worker holding a third of all rows."""

import contextlib
import io

from pyspark.sql import functions as F

from crewgate.operators import flags, listing
from crewgate.schema import COMPANIES, WORKERS, conform

FORCE_SHUFFLE_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextlib.contextmanager
def conf(spark, settings):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def hot_workers(spark, n=60000):
    return conform(spark.range(n).select(
        F.col("id").alias("worker_id"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000 + 8)
         .alias("company_id"),
        F.concat(F.lit("n"), F.col("id")).alias("given_name")), WORKERS, fill_missing=True)


def test_hot_company_join_is_split(spark):
    W = hot_workers(spark)
    C = conform(spark.range(6000).select(F.col("id").alias("company_id"),
                                         F.concat(F.lit("C"), F.col("id")).alias("company_name")),
                COMPANIES, fill_missing=True)
    with conf(spark, FORCE_SHUFFLE_SKEW):
        df = listing.roster(W, C)
        rows = df.collect()
        assert len(rows) == 60000
        assert "SortMergeJoin(skew=true)" in plan(df)


def test_hot_worker_changes_reduce_map_side(spark):
    n = 30000
    ch = spark.range(n).select(
        F.col("id").alias("seq"), F.lit("boss").alias("actor"),
        F.to_json(F.struct(F.lit("worker").alias("type"),
                           F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id"))
                            .alias("id"),
                           F.lit("badge_valid").alias("field"),
                           (F.col("id") % 2).cast("string").alias("clicked"))).alias("change"))
    W = hot_workers(spark, 1000)
    C = conform(spark.range(1).select(F.col("id").alias("company_id")), COMPANIES,
                fill_missing=True)
    new_w, _, _ = flags.apply_flag_changes(ch, W, C, with_outcomes=False)
    text = plan(new_w)
    assert "partial_max_by" in text
    # worker 1 gets the value of the largest seq among its changes
    last = max(i for i in range(n) if i % 3 == 0 or i == 1)
    assert new_w.where("worker_id = 1").first()["badge_valid"] == last % 2


def test_hot_worker_key_is_split(spark):
    """A third of the requests name one worker: the join back is split."""
    from crewgate.operators import quality, workers
    n = 60000
    r = spark.range(n).select(
        F.col("id").alias("seq"), F.lit("Acme").alias("company_name"),
        F.lit(False).alias("_bad_role"), F.lit(False).alias("_bad_date"),
        F.lit(0).alias("_temp"), F.lit(None).cast("date").alias("_date"),
        F.lit(7).cast("long").alias("company_id"),
        F.when(F.col("id") % 3 == 0, F.lit("ann")).otherwise(F.concat(F.lit("n"), F.col("id") % 9000))
         .alias("given_name"), F.lit("lee").alias("surname"),
        F.repeat(F.lit("x"), 40).alias("note")).select(
        "*", *quality.worker_key_cols())
    with conf(spark, FORCE_SHUFFLE_SKEW):
        df = workers.decide(r, hot_workers(spark, 100))
        df = df.where("_reason is null")
        rows = df.collect()
        assert len(rows) == 1 + len({i % 9000 for i in range(n) if i % 3})
        assert min(x["seq"] for x in rows) == 0
        assert "SortMergeJoin(skew=true)" in plan(df)
