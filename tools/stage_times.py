"""Sum task time per bench query (job group) and per stage from an event log.

Usage: python tools/stage_times.py <event log file or folder> [top_n]
"""

from __future__ import annotations

import collections
import glob
import json
import os
import sys


def _open(path: str):
    if path.endswith(".zstd"):
        import io
        import zstandard
        return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(path, "rb")),
                                encoding="utf-8")
    return open(path, encoding="utf-8")


def main(path: str, top: int = 12) -> None:
    group_of_job, stage_group, stage_name = {}, {}, {}
    task_ms = collections.Counter()
    jobs = collections.Counter()
    files = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else [path]
    lines = (ln for f in files if not os.path.basename(f).startswith("appstatus")
             for ln in _open(f))
    if True:
        for line in lines:
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                props = ev.get("Properties") or {}
                g = props.get("spark.jobGroup.id", "-")
                jobs[g] += 1
                for st in ev.get("Stage Infos", []):
                    stage_group[st["Stage ID"]] = g
                    stage_name[st["Stage ID"]] = st.get("Stage Name", "")
            elif kind == "SparkListenerTaskEnd":
                info = ev.get("Task Info", {})
                ms = info.get("Finish Time", 0) - info.get("Launch Time", 0)
                task_ms[ev.get("Stage ID")] += ms
    per_group = collections.Counter()
    for st, ms in task_ms.items():
        per_group[stage_group.get(st, "-")] += ms
    print(f"{'query':28s} {'jobs':>5s} {'task s':>8s}")
    for g, ms in per_group.most_common():
        print(f"{g:28s} {jobs[g]:5d} {ms / 1000:8.2f}")
    print("\nheaviest stages:")
    for st, ms in task_ms.most_common(top):
        print(f"  stage {st:5d} {stage_group.get(st, '-'):24s} {ms / 1000:7.2f}s  "
              f"{stage_name.get(st, '')[:60]}")


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 12)
