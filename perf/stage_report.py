"""Summarise a Spark event log: the slowest stages with task counts and the
spread of task times (max / median shows skew).

    python perf/stage_report.py <event-log-file-or-dir> [top]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
from collections import defaultdict


def read_events(path: str):
    """Events of a plain or rolling (``eventlog_v2_*``) log, zstd or not."""
    files = [path] if os.path.isfile(path) else sorted(
        os.path.join(root, f) for root, _, names in os.walk(path) for f in names
        if not f.startswith(".") and not f.startswith("appstatus"))
    for f in files:
        if f.endswith(".zstd"):
            import io

            import zstandard
            with open(f, "rb") as raw:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
                for line in text:
                    yield json.loads(line)
        else:
            with open(f) as fh:
                for line in fh:
                    yield json.loads(line)


def main(argv):
    path, top = argv[1], int(argv[2]) if len(argv) > 2 else 15
    tasks = defaultdict(list)
    stages = {}
    for ev in read_events(path):
        kind = ev.get("Event")
        if kind == "SparkListenerTaskEnd":
            info = ev["Task Info"]
            key = (ev["Stage ID"], ev["Stage Attempt ID"])
            tasks[key].append(info["Finish Time"] - info["Launch Time"])
        elif kind == "SparkListenerStageCompleted":
            si = ev["Stage Info"]
            key = (si["Stage ID"], si["Stage Attempt ID"])
            dur = si.get("Completion Time", 0) - si.get("Submission Time", 0)
            stages[key] = (dur, si.get("Stage Name", "")[:70])
    rows = []
    for key, (dur, name) in stages.items():
        t = tasks.get(key, [])
        med = statistics.median(t) if t else 0
        rows.append((dur, key[0], len(t), max(t) if t else 0, med, name))
    rows.sort(reverse=True)
    print(f"{'ms':>7} {'stage':>6} {'tasks':>6} {'max':>6} {'median':>7}  name")
    for dur, sid, n, mx, med, name in rows[:top]:
        print(f"{dur:7d} {sid:6d} {n:6d} {mx:6d} {med:7.0f}  {name}")


if __name__ == "__main__":
    main(sys.argv)
