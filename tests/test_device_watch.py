"""Devices as a state machine by processing time: silent logs, repeated ends, restarts."""

import json
import time

import pytest

from circuitscope.streaming import device_watch, resume

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def write(folder, name, *records):
    (folder / f"{name}.tmp").write_text("".join(json.dumps(r) + "\n" for r in records))
    (folder / f"{name}.tmp").rename(folder / f"{name}.jsonl")


def row(device, key, status, phase=None, second=0, **more):
    return {"device": device, "key": key, "status": status, "phase": phase, "timestamp": f"2024-01-01T00:00:{second:02d}Z"} | more


def start(spark, tmp_path, events, **limits):
    log = resume.read_log(spark, str(tmp_path / "log") + "/*.jsonl")
    return (device_watch.watch_devices(log, **limits).writeStream.trigger(processingTime="1 second").outputMode("append").option("checkpointLocation", str(tmp_path / "ck"))
            .foreachBatch(lambda b, _: events.extend(tuple(r) for r in b.collect())).start())


def taken(query, n, seconds=90):
    """Waits until n rows were read; timers keep such a query busy, so it is never idle."""
    seen, end = {}, time.time() + seconds
    while sum(seen.values()) < n and time.time() < end and query.exception() is None:
        seen |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
        time.sleep(0.2)
    assert sum(seen.values()) >= n, (seen, query.exception())


def wait_for(events, n, seconds=60):
    end = time.time() + seconds
    while len(events) < n and time.time() < end:
        time.sleep(0.2)


def test_silent_logs_fire_timers_also_after_a_restart(rocks, tmp_path):
    (tmp_path / "log").mkdir()
    events = []
    limits = {"phase_seconds": 8, "startup_seconds": 8, "grace_seconds": 0, "max_attempts": 3}
    query = start(rocks, tmp_path, events, **limits)
    write(tmp_path / "log", "1", row("a", "j1", "queued"), row("a", "j2", "queued", attempt=1), row("b", "k1", "queued"), row("b", "b", "ready", second=1),
          row("b", "k1", "running", "started", 2), row("b", "k2", "running", "started", 3), row("b", "k1", "success", second=4), row("b", "k1", "success", second=5), row(None, "x", "queued"))
    taken(query, 9)
    assert sorted(events, key=str) == sorted([("b", None, "ready", 0), ("b", "k1", "finished", 1)], key=str)
    query.stop()
    events.clear()
    query = start(rocks, tmp_path, events, **limits)  # nothing is written any more: only the clock goes on
    wait_for(events, 3)
    query.stop()
    assert sorted(events, key=str) == sorted([("a", "j1", "startup_timeout", 3), ("a", "j2", "startup_timeout", 3), ("b", "k2", "watchdog_timeout", 1)], key=str)


def test_late_ends_new_attempts_and_closed_devices(rocks, tmp_path):
    (tmp_path / "log").mkdir()
    events = []
    query = start(rocks, tmp_path, events, phase_seconds=600, startup_seconds=600, grace_seconds=0)
    steps = [[row("a", "j", "queued"), row("a", "j", "running", "loading", 1), row("a", "j", "running", "started", 2)], [row("a", "j", "timeout", second=3)], [row("a", "j", "success", second=4)],
             [row("a", "j", "queued", attempt=1, second=5), row("a", "j", "running", "started", 6)], [row("a", "j", "success", second=7), row("a", "a", "done", second=8)], [row("a", "a", "done", second=9)]]
    for k, records in enumerate(steps):
        write(tmp_path / "log", str(k), *records)
        taken(query, sum(map(len, steps[:k + 1])))
    query.stop()
    assert events == [("a", "j", "finished", 1), ("a", "j", "finished", 2), ("a", None, "done", 0)]
