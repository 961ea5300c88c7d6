import json
import os

from crewgate.operators import flags
from crewgate.schema import COMPANIES, WORKERS
from crewgate.sources.changes import read_change_files
from crewgate.streaming import flag_stream
from fixtures import company_row, worker_row


def base(spark):
    W = spark.createDataFrame([worker_row(1, badge_issued=0, badge_valid=0),
                               worker_row(2, badge_cancelled=0)], WORKERS)
    C = spark.createDataFrame([company_row(1, "Acme", sole=0)], COMPANIES)
    return W, C


RECORDS = [
    (1, "boss", '{"type":"worker","id":1,"field":"badge_valid","clicked":"1"}'),
    (3, "boss", '{"type":"worker","id":1,"field":"badge_valid","clicked":0}'),
    (2, "boss", '{"type":"worker","id":1,"field":"badge_valid","clicked":"1"}'),
    (4, "boss", '{"type":"worker","id":1,"field":"badge_issued","clicked":1}'),
    (5, "clerk", '{"type":"worker","id":2,"field":"badge_issued","clicked":1}'),
    (6, "boss", '{"type":"worker","id":2,"field":"badge_cancelled"}'),
    (7, "boss", '{"type":"worker","id":2,"field":"badge_cancelled","clicked":null}'),
    (8, "boss", '{"type":"worker","id":2,"field":"badge_cancelled","clicked":"2"}'),
    (9, "boss", '{"type":"worker","id":2,"field":"badge_cancelled","clicked":"x"}'),
    (10, "boss", '{"type":"worker","field":"badge_cancelled","clicked":"1"}'),
    (11, "boss", '{"type":"truck","id":2,"field":"badge_cancelled","clicked":"1"}'),
    (12, "boss", '{"type":"worker","id":2,"field":"colour","clicked":"1"}'),
    (13, "boss", '{"type":"worker","id":77,"field":"record_updated","clicked":"1"}'),
    (14, "boss", '{"type":"company","id":1,"field":"is_sole_trader","clicked":" 1 "}'),
    (15, "boss", '{"type":"company","id":1,"field":"badge_valid","clicked":"1"}'),
]


def changes(spark):
    return spark.createDataFrame(RECORDS, "seq long, actor string, change string")


def test_reasons(spark):
    W, C = base(spark)
    out = flags.change_outcomes(changes(spark), W, C, allowed_actors=["boss"])
    got = {r["seq"]: r["reason"] for r in out.collect()}
    assert got == {1: "applied", 2: "applied", 3: "applied", 4: "applied", 5: "forbidden",
                   6: "missing_clicked", 7: "bad_value", 8: "bad_value", 9: "bad_value",
                   10: "missing_fields", 11: "unknown_type", 12: "unknown_field",
                   13: "not_found", 14: "applied", 15: "unknown_field"}


def snapshot(W, C, ch, actors=("boss",)):
    new_w, new_c, _ = flags.apply_flag_changes(ch, W, C, list(actors))
    return (sorted(tuple(r) for r in new_w.collect()), sorted(tuple(r) for r in new_c.collect()))


def test_last_by_seq_wins_and_replay_is_idempotent(spark):
    W, C = base(spark)
    ch = changes(spark)
    w1, c1 = snapshot(W, C, ch)
    by = {r[0]: r for r in w1}
    assert by[1][8] == 0 and by[1][5] == 1      # valid: seq 3 (0) beats seq 2 (1)
    assert by[2][5] == 1 and by[2][10] == 0     # clerk may not set badge_issued
    assert c1[0][7] == 1
    # applying the same batch to its own result changes nothing
    W2 = spark.createDataFrame(w1, WORKERS)
    C2 = spark.createDataFrame(c1, COMPANIES)
    assert snapshot(W2, C2, ch) == (w1, c1)
    # a replayed batch (every record twice) gives the same snapshot
    assert snapshot(W, C, ch.unionByName(ch)) == (w1, c1)


def test_stream_equals_batch(spark, scratch):
    W, C = base(spark)
    feed = os.path.join(scratch, "feed")
    os.makedirs(feed)
    # three files; the second holds older records than the first (late data)
    parts = [RECORDS[8:], RECORDS[:4], RECORDS[4:8]]
    for i, part in enumerate(parts):
        with open(os.path.join(feed, f"part-{i}.json"), "w") as fh:
            for seq, actor, change in part:
                fh.write(json.dumps({"seq": seq, "actor": actor, "change": change}) + "\n")
    root = os.path.join(scratch, "state")
    q = flag_stream.start_flag_stream(flag_stream.read_change_stream(spark, feed), root,
                                      os.path.join(root, "_ckpt"), ["boss"])
    q.awaitTermination()
    assert q.lastProgress is not None
    new_w, new_c = flags.apply_latest(flag_stream.state_rows(spark, root), W, C)
    assert (sorted(tuple(r) for r in new_w.collect()),
            sorted(tuple(r) for r in new_c.collect())) == snapshot(W, C, changes(spark))
    # the same files read as a batch give the same snapshot
    assert snapshot(W, C, read_change_files(spark, feed)) == snapshot(W, C, changes(spark))


def test_stream_parts_and_compaction(spark, scratch):
    W, C = base(spark)
    feed = os.path.join(scratch, "feed")
    os.makedirs(feed)
    for i, part in enumerate([RECORDS[:5], RECORDS[5:10], RECORDS[10:]]):
        with open(os.path.join(feed, f"part-{i}.json"), "w") as fh:
            for seq, actor, change in part:
                fh.write(json.dumps({"seq": seq, "actor": actor, "change": change}) + "\n")
    root = os.path.join(scratch, "state")
    q = flag_stream.start_flag_stream(flag_stream.read_change_stream(spark, feed), root,
                                      os.path.join(root, "_ckpt"), ["boss"])
    q.awaitTermination()
    name = flag_stream.feed_name(os.path.join(root, "_ckpt"))
    batches = os.path.join(root, "batches", f"feed={name}")
    assert len([d for d in os.listdir(batches) if d.startswith("batch_id=")]) >= 2
    before = latest(spark, root)
    flag_stream.compact(spark, root, name, 1)
    assert latest(spark, root) == before
    # a batch after the compaction counts, and a second compaction builds on the first
    sink = flag_stream.batch_writer(root, name)
    sink(spark.createDataFrame([("worker", 1, "badge_valid", 0, 999)], flag_stream.STATE), 7)
    assert ("worker", 1, "badge_valid", 0, 999) in latest(spark, root)
    after = latest(spark, root)
    flag_stream.compact(spark, root, name, 7)
    assert latest(spark, root) == after
    assert sorted(tuple(r) for r in flags.apply_latest(
        flag_stream.state_rows(spark, root), W, C)[0].collect()) == sorted(
        tuple(r) for r in flags.apply_latest(flag_stream.latest_table(spark, root), W, C)[0]
        .collect())


def latest(spark, root):
    return sorted(tuple(r) for r in flag_stream.latest_table(spark, root).collect())


def test_an_unfinished_compaction_is_not_read(spark, scratch):
    sink = flag_stream.batch_writer(scratch, "f")
    sink(spark.createDataFrame([("worker", 1, "badge_valid", 1, 5)], flag_stream.STATE), 0)
    os.makedirs(os.path.join(scratch, "bases", "feed=f", "base_upto=0"))     # no _SUCCESS
    assert latest(spark, scratch) == [("worker", 1, "badge_valid", 1, 5)]


def test_stream_with_processing_time_trigger(spark, scratch):
    W, C = base(spark)
    feed = os.path.join(scratch, "feed")
    os.makedirs(feed)
    with open(os.path.join(feed, "part-0.json"), "w") as fh:
        for seq, actor, change in RECORDS:
            fh.write(json.dumps({"seq": seq, "actor": actor, "change": change}) + "\n")
    root = os.path.join(scratch, "state")
    q = flag_stream.start_flag_stream(flag_stream.read_change_stream(spark, feed), root,
                                      os.path.join(root, "_ckpt"), ["boss"],
                                      available_now=False)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    new_w, new_c = flags.apply_latest(flag_stream.state_rows(spark, root), W, C)
    assert (sorted(tuple(r) for r in new_w.collect()),
            sorted(tuple(r) for r in new_c.collect())) == snapshot(W, C, changes(spark))


def test_stream_plan_has_no_join(spark, scratch):
    import contextlib
    import io
    feed = os.path.join(scratch, "feed")
    os.makedirs(feed)
    with open(os.path.join(feed, "part-0.json"), "w") as fh:
        fh.write(json.dumps({"seq": 1, "actor": "boss", "change": RECORDS[0][2]}) + "\n")
    state = flag_stream.flag_state(flag_stream.read_change_stream(spark, feed), ["boss"])
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        state.explain()
    assert state.isStreaming and "Join" not in buf.getvalue()


def test_replayed_batches_and_new_checkpoints(spark, scratch):
    sink = flag_stream.batch_writer(scratch, "one")
    sink(spark.createDataFrame([("worker", 1, "badge_valid", 1, 5)], flag_stream.STATE), 0)
    sink(spark.createDataFrame([("worker", 1, "badge_valid", 1, 5)], flag_stream.STATE), 0)
    sink(spark.createDataFrame([("worker", 1, "badge_valid", 0, 9)], flag_stream.STATE), 1)
    assert latest(spark, scratch) == [("worker", 1, "badge_valid", 0, 9)]
    # a stream with a new checkpoint starts at batch 0 again and loses nothing
    other = flag_stream.batch_writer(scratch, "two")
    other(spark.createDataFrame([("worker", 2, "badge_valid", 1, 12)], flag_stream.STATE), 0)
    assert latest(spark, scratch) == [("worker", 1, "badge_valid", 0, 9),
                                      ("worker", 2, "badge_valid", 1, 12)]
    flag_stream.compact(spark, scratch, "one", 1)
    assert latest(spark, scratch) == [("worker", 1, "badge_valid", 0, 9),
                                      ("worker", 2, "badge_valid", 1, 12)]


def test_outcomes_of_the_feed(spark, scratch):
    """One row per record as the batch operator gives it, whatever is read or replayed."""
    W, C = base(spark)
    want = sorted(map(tuple, flags.change_outcomes(changes(spark), W, C, ["boss"]).collect()), key=repr)
    feed, root = os.path.join(scratch, "feed"), os.path.join(scratch, "out")
    os.makedirs(feed)
    assert flag_stream.feed_outcomes(spark, root, W, C).count() == 0
    for i, part in enumerate([RECORDS[:5], RECORDS[5:]]):
        with open(os.path.join(feed, f"part-{i}.json"), "w") as fh:
            for seq, actor, change in part:
                fh.write(json.dumps({"seq": seq, "actor": actor, "change": change}) + "\n")
    read = lambda: sorted(map(tuple, flag_stream.feed_outcomes(
        spark, root, W, C).collect()), key=repr)
    for checkpoint in ("_one", "_one", "_two"):      # run again, then with a new checkpoint
        flag_stream.start_outcome_stream(
            flag_stream.read_change_stream(spark, feed), root, os.path.join(scratch, checkpoint),
            ["boss"]).awaitTermination()
        assert read() == want
    # a batch replayed after a failure rewrites its own folder
    name = flag_stream.feed_name(os.path.join(scratch, "_one"))
    batch = spark.read.parquet(os.path.join(root, "outcomes", f"feed={name}", "batch_id=0"))
    again = spark.createDataFrame(batch.collect(), batch.schema)
    flag_stream.batch_writer(root, name, "outcomes")(again, 0)
    assert read() == want


def test_a_backlog_takes_few_batches(spark, scratch):
    """The number of micro-batches does not grow with the number of files."""
    feed = os.path.join(scratch, "feed")
    os.makedirs(feed)
    for i in range(20):
        with open(os.path.join(feed, f"part-{i}.json"), "w") as fh:
            fh.write(json.dumps({"seq": i, "actor": "boss", "change": RECORDS[0][2]}) + "\n")
    per = [flag_stream.files_per_batch(spark, feed, n) for n in (1, 4, 8, 20, 21)]
    assert per == [20, 5, 3, 1, 1]
    root = os.path.join(scratch, "out")
    flag_stream.start_outcome_stream(
        flag_stream.read_change_stream(spark, feed, flag_stream.files_per_batch(spark, feed)),
        root, os.path.join(root, "_ckpt"), ["boss"]).awaitTermination()
    rows = spark.read.parquet(os.path.join(root, "outcomes"))
    assert sorted(r.seq for r in rows.collect()) == list(range(20))
    assert 1 < rows.select("batch_id").distinct().count() <= flag_stream.BACKLOG_BATCHES


def test_change_files_are_written_by_many_tasks(spark, scratch):
    from crewgate.sources import testviews as V

    spark.range(200).selectExpr("id AS event_id", "id % 7 AS user_id", "'click' AS event_type",
                                "double(id) AS value").write.parquet(f"{scratch}/events.parquet")
    path = V.write_change_files(spark, scratch, f"{scratch}/feed", rows_per_file=10)
    sizes = {}
    for name in os.listdir(path):
        if name.startswith("part-"):
            with open(os.path.join(path, name)) as fh:
                sizes[name] = sum(1 for _ in fh)
    assert sum(sizes.values()) == 200 and max(sizes.values()) <= 10
    assert len({name.split("-")[1] for name in sizes}) > 4


def test_a_feed_without_batches_is_empty(spark, scratch):
    W, C = base(spark)
    root = os.path.join(scratch, "nothing")
    assert latest(spark, root) == []
    assert flags.apply_latest(flag_stream.state_rows(spark, root), W, C)[0].count() == W.count()


def test_a_complete_base_is_never_replaced(spark, scratch):
    import pytest

    sink = flag_stream.batch_writer(scratch, "f")
    for n in range(2):
        sink(spark.createDataFrame([("worker", 1, "badge_valid", n, 5 + n)], flag_stream.STATE), n)
    flag_stream.compact(spark, scratch, "f", 1)
    for upto in (0, 1):
        with pytest.raises(ValueError):
            flag_stream.compact(spark, scratch, "f", upto)
    assert latest(spark, scratch) == [("worker", 1, "badge_valid", 1, 6)]


def test_change_objects_as_the_endpoint_takes_them(spark):
    sent = {1: '{"type":"worker","id":"12","field":"badge_valid","clicked":true}',
            2: '{"type":"worker","id":" 12 ","field":"badge_valid","clicked":1.0}',
            3: '{"type":"worker","id":12,"field":"badge_valid","clicked":"1.0"}',
            4: '{"type":"worker","id":12,"field":"badge_valid","clicked":false}',
            5: '{"type":"worker","id":12,"field":"badge_valid","clicked":0.9}',
            6: '{"type":"worker","id":12,"field":"badge_valid","clicked":null}',
            7: '{"type":"worker","id":12,"field":"badge_valid"}',
            8: '{"type":"worker","id":"x","field":"badge_valid","clicked":1}',
            9: '{"type":"worker","id":12,"field":"badge_valid","clicked":[1]}',
            10: 'not json', 11: None,
            12: '{"type":"worker","id":12,"field":"badge_valid","clicked":-1}'}
    df = spark.createDataFrame([(k, "boss", v) for k, v in sent.items()],
                               "seq long, actor string, change string")
    got = {r.seq: (r.id, r.value, r.reason) for r in flags.checked_changes(df).collect()}
    bad, none = flags.BAD_VALUE, flags.MISSING_CLICKED
    assert got == {1: (12, 1, None), 2: (12, 1, None), 3: (12, None, bad), 4: (12, 0, None),
                   5: (12, 0, None), 6: (12, None, bad), 7: (12, None, none),
                   8: (None, 1, flags.MISSING_FIELDS), 9: (12, None, bad), 10: (None, None, none),
                   11: (None, None, none), 12: (12, None, bad)}


def test_one_exchange_before_the_join(spark):
    W, C = base(spark)
    new_w, _, _ = flags.apply_flag_changes(changes(spark), W, C, with_outcomes=False)
    plan = new_w._jdf.queryExecution().executedPlan().toString()
    changed = plan[plan.index("max_by"):]
    assert changed.count("Exchange hashpartitioning(") <= 1 and "pivot" not in plan.lower()
