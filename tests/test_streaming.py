"""The log as a stream, through restarts."""

import json

from circuitscope.streaming import resume


def write(folder, name, *records):
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def run(query):
    query.processAllAvailable()
    query.stop()


def test_latest_status_survives_a_restart(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    write(source, "1.jsonl", {"key": "a", "status": "success", "attempt": 2, "timestamp": "2024-01-01T00:00:01Z"}, {"key": "a", "status": "running", "attempt": 2, "timestamp": "2024-01-01T00:00:02Z"},
          {"key": "a", "status": "timeout", "attempt": 1, "timestamp": "2024-01-01T00:00:00Z"}, {"key": 7}, {"key": "b", "status": "running", "attempt": 1})
    table = []

    def start():
        log = resume.read_log(spark, str(source))
        return resume.latest_status(log).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(
            lambda batch, _: table.extend(batch.collect())).start()

    run(start())
    assert {r.key: (r.status, r.attempts) for r in table} == {"a": ("success", 2), "b": (None, 1)}
    table.clear()
    write(source, "2.jsonl", {"key": "a", "status": "timeout", "attempt": 3, "timestamp": "2024-01-01T00:10:00Z"})
    run(start())
    assert [(r.key, r.status, r.attempts) for r in table] == [("a", "timeout", 3)]


def test_watchdog_fires_once_by_event_time(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    at = lambda minute: f"2024-01-01T00:{minute:02d}:00Z"
    write(source, "1.jsonl", {"key": "slow", "status": "running", "phase": "started", "timestamp": at(0)}, {"key": "quick", "status": "running", "phase": "started", "timestamp": at(0)})
    events = []
    log = resume.read_log(spark, str(source), max_files=1)
    query = resume.watch_phases(log).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, _: events.extend(b.collect())).start()
    query.processAllAvailable()
    write(source, "2.jsonl", {"key": "quick", "status": "success", "timestamp": at(1)})
    query.processAllAvailable()
    write(source, "3.jsonl", {"key": "other", "status": "running", "phase": "started", "timestamp": at(20)})
    query.processAllAvailable()
    query.stop()
    assert sorted((e.key, e.event, e.attempt) for e in events) == [("quick", "finished", 1), ("slow", "watchdog_timeout", 1)]


def test_attempts_go_on_counting_and_startup_times_out(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    record = lambda minute, status, phase=None, key="job": {"key": key, "status": status, "phase": phase, "timestamp": f"2024-01-01T00:{minute:02d}:00Z"}
    steps = [[record(0, "running", "started"), record(0, "running", "queued", "late")], [record(1, "timeout")], [record(2, "running", "started")], [record(3, "success")],
             [record(30, "running", "started", "other")], [record(31, "success", None, "other")]]
    events = []
    log = resume.read_log(spark, str(source), max_files=1)
    query = resume.watch_phases(log).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda b, _: events.extend(b.collect())).start()
    for k, records in enumerate(steps):
        write(source, f"{k}.jsonl", *records)
        query.processAllAvailable()
    query.stop()
    assert [(e.event, e.attempt) for e in events if e.key == "job"] == [("finished", 1), ("finished", 2)]
    assert [(e.event, e.attempt) for e in events if e.key == "late"] == [("startup_timeout", 0)]
