"""Benchmark the headline queries; prints ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8),
BENCH_RUNS (3: one first run, then warm runs; the best warm run is
reported, the first run is kept beside it).  Each query is executed in full
with a ``noop`` write (nothing is collected to the driver); input files a
query needs (the raw roster CSV, the change feed) are written before timing,
and a short warm-up (JIT) runs before the first query.  With
BENCH_EVENT_LOG_DIR set, Spark writes its event log there and every query
runs under its own job group (read it with ``tools/stage_times.py``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crewgate.operators import flags, load  # noqa: E402
from crewgate.plans import catalog as Q  # noqa: E402
from crewgate.session import build_session, scratch_path  # noqa: E402
from crewgate.sources import roster_csv  # noqa: E402
from crewgate.sources import testviews as V  # noqa: E402
from crewgate.streaming import flag_stream  # noqa: E402


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    log_dir = os.environ.get("BENCH_EVENT_LOG_DIR")
    extra = ({"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
              "spark.eventLog.compress": "false"} if log_dir else {})
    spark = build_session(f"local[{cpus}]", max(8, cpus), app="crewgate-bench", extra=extra)

    raw_dir = V.write_raw_roster(spark, sf_dir, scratch_path(spark, "bench-raw"))
    feed_dir = V.write_change_files(spark, sf_dir, scratch_path(spark, "bench-feed"))

    def bulk_load():
        clean = load.clean_roster(roster_csv.read_roster_csv(spark, raw_dir))
        new_c, new_w, _ = load.bulk_load(clean, V.companies(spark, sf_dir),
                                         V.workers(spark, sf_dir))
        run_noop(new_c)
        run_noop(new_w)

    def stream_flag_changes():
        W, C = V.workers(spark, sf_dir), V.companies(spark, sf_dir)
        root = scratch_path(spark, "bench-state")
        q = flag_stream.start_flag_stream(flag_stream.read_change_stream(spark, feed_dir),
                                          root, f"{root}/_ckpt", Q.ALLOWED_ACTORS)
        q.awaitTermination()
        new_w, _ = flags.apply_latest(flag_stream.state_rows(spark, root), W, C)
        run_noop(new_w)

    def registered(name):
        return lambda: run_noop(Q.QUERIES[name](spark, sf_dir))

    plan = {
        "expired_badges": registered("expired_badges"),
        "expired_counts": registered("expired_counts"),
        "weekly_valid": registered("weekly_valid"),
        "weekly_totals": registered("weekly_totals"),
        "roster_full": registered("roster_full"),
        "column_widths": registered("column_widths"),
        "report_lines": registered("report_lines"),
        "workers_by_surname": registered("workers_by_surname"),
        "new_companies_accepted": registered("new_companies_accepted"),
        "new_companies_greedy": registered("new_companies_greedy"),
        "new_workers_outcomes": registered("new_workers_outcomes"),
        "worker_edits": registered("worker_edits"),
        "flag_changes_snapshot": registered("flag_changes_snapshot"),
        "upsert_by_key": registered("upsert_by_key"),
        "bulk_load": bulk_load,
        "stream_flag_changes": stream_flag_changes,
    }
    for _ in range(3):  # JIT warm-up on the smallest registered query
        run_noop(Q.QUERIES["role_list"](spark, sf_dir))
    # one-time start of the streaming state store (native library, instance)
    # on a ten-record feed, so that it is not charged to a timed run
    tiny = scratch_path(spark, "bench-tiny-feed")
    V.flag_change_records(spark, sf_dir).orderBy("seq").limit(10).write.json(tiny)
    tiny_root = scratch_path(spark, "bench-tiny-state")
    flag_stream.start_flag_stream(flag_stream.read_change_stream(spark, tiny), tiny_root,
                                  f"{tiny_root}/_ckpt").awaitTermination()
    first, warm = {}, {}
    for name, fn in plan.items():
        spark.sparkContext.setJobGroup(name, name)
        for i in range(runs):
            t0 = time.perf_counter()
            fn()
            dt = round(time.perf_counter() - t0, 3)
            if i == 0:
                first[name] = dt
            else:
                warm[name] = min(dt, warm.get(name, dt))
    best = {k: warm.get(k, first[k]) for k in first}
    total = round(sum(best.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_warm", "value": total, "unit": "sec",
                      "queries": best, "first_run": first, "sf": sf,
                      "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
