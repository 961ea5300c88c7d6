"""Summarise the physical plan of every registered query as a markdown table.

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md-fragment
Counts shuffles (Exchange), join strategies, whole-stage-codegen stages and
the filters pushed into parquet scans.  The static plan is shown (AQE off
while explaining): AQE may only improve it at runtime (broadcast a side
that turns out small, coalesce or split partitions).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plan_text(df, mode=None) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode) if mode else df.explain()
    return buf.getvalue()


def summary(df) -> dict:
    simple = plan_text(df)
    formatted = plan_text(df, "formatted")
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                       r"BroadcastNestedLoopJoin|CartesianProduct) \[.*?\], \[.*?\], (\w+)",
                       simple)
    exchanges = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|"
                               r"RoundRobinPartitioning)", simple))
    broadcasts = simple.count("BroadcastExchange")
    stages = len(set(re.findall(r"\*\((\d+)\)", simple)))
    pushed = sorted({p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", formatted) if p})
    nodes = [ln.strip() for ln in simple.splitlines() if ln.strip().startswith(("+-", ":-"))]
    uncoded = sorted({re.sub(r"^[+:\- ]+", "", n).split(" ")[0].split("(")[0] for n in nodes
                      if not re.search(r"\*\(\d+\)", n)}
                     - {"Exchange", "BroadcastExchange", "AdaptiveSparkPlan", "ReusedExchange",
                        "Scan", "InMemoryTableScan"})
    return {"exchanges": exchanges, "broadcasts": broadcasts,
            "joins": ", ".join(sorted({f"{b} {a}" for a, b in joins})) or "-",
            "codegen_stages": stages, "pushed": "; ".join(pushed)[:140] or "-",
            "outside_codegen": ", ".join(uncoded) or "-"}


if __name__ == "__main__":
    from crewgate.session import build_session
    from crewgate.plans.catalog import QUERIES
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8, extra={"spark.sql.adaptive.enabled": "false"})
    print("| Query | Shuffles | Broadcasts | Joins | Codegen stages | Outside codegen | "
          "Pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name in sorted(QUERIES):
        s = summary(QUERIES[name](spark, sf))
        print(f"| `{name}` | {s['exchanges']} | {s['broadcasts']} | {s['joins']} | "
              f"{s['codegen_stages']} | {s['outside_codegen']} | {s['pushed']} |", flush=True)
