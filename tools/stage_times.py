"""Stage and task time per bench query, from a Spark event log.

    BENCH_EVENT_LOG_DIR=$(mktemp -d /tmp/run-XXXXXX) python bench.py
    python tools/stage_times.py <that dir>/<app-id>

The bench tags each query's jobs with a job group named after the query.
Prints, per query: jobs, stages, tasks, summed task time, shuffle bytes
written and spilled bytes.
"""

from __future__ import annotations

import json
import os
import sys
from collections import defaultdict


def _event_files(path: str) -> list[str]:
    """A log file, an app's rolling log dir (Spark 4: eventlog_v2_*), or a
    folder holding one of those (the newest is taken)."""
    if os.path.isfile(path):
        return [path]
    names = sorted(os.listdir(path))
    parts = [n for n in names if n.startswith("events_")]
    if parts:
        return [os.path.join(path, n) for n in sorted(parts, key=lambda n: int(n.split("_")[1]))]
    names = [n for n in names if not n.startswith("appstatus_")]
    return _event_files(os.path.join(path, names[-1]))


def _lines(path: str):
    import io
    for name in _event_files(path):
        if name.endswith(".zstd"):
            import zstandard
            with open(name, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(name, encoding="utf-8") as f:
                yield from f


def main(path: str) -> None:
    job_group, stage_job = {}, {}
    stats = defaultdict(lambda: defaultdict(int))
    for line in _lines(path):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            group = (ev.get("Properties") or {}).get("spark.jobGroup.id", "?")
            job_group[ev["Job ID"]] = group
            stats[group]["jobs"] += 1
            for sid in ev.get("Stage IDs", []):
                stage_job[sid] = ev["Job ID"]
        elif kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            group = job_group.get(stage_job.get(info["Stage ID"]), "?")
            stats[group]["stages"] += 1
            stats[group]["tasks"] += info.get("Number of Tasks", 0)
        elif kind == "SparkListenerTaskEnd":
            group = job_group.get(stage_job.get(ev["Stage ID"]), "?")
            m = ev.get("Task Metrics") or {}
            stats[group]["task_ms"] += m.get("Executor Run Time", 0)
            stats[group]["shuffle_write_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
            stats[group]["spill_bytes"] += m.get("Disk Bytes Spilled", 0)
    cols = ["jobs", "stages", "tasks", "task_ms", "shuffle_write_bytes", "spill_bytes"]
    print("query".ljust(26) + "".join(c.rjust(20) for c in cols))
    for group, s in stats.items():
        print(group.ljust(26) + "".join(str(s[c]).rjust(20) for c in cols))


if __name__ == "__main__":
    main(sys.argv[1])
