"""Coverage kept up by the log against the batch operators, and results matched to starts as streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from circuitscope.operators import jobs as J
from circuitscope.sources import readers
from circuitscope.streaming import progress

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def write(folder, name, records):
    (folder / f"{name}.tmp").write_text("".join(json.dumps(r) + "\n" for r in records))
    (folder / f"{name}.tmp").rename(folder / f"{name}.jsonl")


def test_coverage_equals_the_batch_operators_after_every_batch(rocks, tmp_path):
    spark = rocks
    (tmp_path / "log").mkdir()
    path = str(tmp_path / "log") + "/*.jsonl"
    jobs = spark.createDataFrame([(f"c{c}", f"c{c}|d{d}", f"d{d}", c) for c in range(6) for d in range(3)], "circuit string, key string, device string, num_qubits int")
    rng, view, emitted = random.Random(3), {r.circuit: (3, 0, 3, False) for r in jobs.select("circuit").distinct().collect()}, []

    def take(batch, _):
        rows = batch.collect()
        emitted.append(len(rows))
        view.update({r.circuit: tuple(r)[1:] for r in rows})

    def run():
        query = (progress.circuit_progress(progress.read_records(spark, path), jobs, max_attempts=3).writeStream.outputMode("update")
                 .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(take).start())
        query.awaitTermination(120)
        assert query.exception() is None

    minute = 0
    for k in range(3):  # each run restarts from the checkpoint
        records = []
        for _ in range(15):
            minute += 1
            c, d = rng.randrange(7), rng.randrange(3)
            status = rng.choice(["success", "success", "running", "timeout"])
            records.append({"key": f"c{c}|d{d}", "circuit": f"c{c}", "device": f"d{d}", "status": status, "mode": "rl" if status == "success" and rng.random() < 0.8 else "fallback",
                            "attempt": rng.randint(1, 3), "timestamp": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"})
        rng.shuffle(records)  # the order of lines doesn't matter, their times do
        write(tmp_path / "log", str(k), records)
        run()
        lines = spark.read.text(path).select(F.struct(F.try_to_timestamp(F.get_json_object("value", "$.timestamp")).alias("logged")).alias("line_no"), "value")
        log = readers.parse_manifest(lines)
        latest = J.latest_records(log)
        valid = latest.where(J.strict_success()).select("key")
        pending = {r.circuit: r.n for r in J.pending_jobs(jobs, valid, J.attempts_and_status(log), 3).groupBy("circuit").agg(F.count("*").alias("n")).collect()}
        want = {r.circuit: (r.n_jobs, r.n_valid, pending.get(r.circuit, 0), r.complete) for r in J.coverage(jobs, valid).collect()}
        assert view == want
    assert any(w[1] for w in view.values()) and max(emitted) < 7


def test_results_meet_the_jobs_that_started(spark, tmp_path):
    for name in ("starts", "results"):
        (tmp_path / name).mkdir()
    at = lambda m, s=0: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:{s:02d}Z"
    begun = lambda device, pid, key, when: {"device": device, "pid": pid, "key": key, "started": when}
    ended = lambda message, device, pid, status, when: {"message": message, "device": device, "pid": pid, "status": status, "finished": when}
    steps = [([begun("a", 1, "j1", at(0)), begun("b", 1, "k1", at(0))], [ended("m1", "a", 1, "success", at(2)), ended("m1", "a", 1, "success", at(2)), ended("m9", "a", 9, "lost", at(3))]),
             ([begun("a", 1, "j2", at(15))], [ended("m1", "a", 1, "success", at(2)), ended("m2", "a", 1, "timeout", at(16)), ended("m0", "b", 2, "early", at(17))]),
             ([begun("b", 2, "k2", at(18))], [ended("m3", "b", 2, "success", at(19))]), ([begun("z", 0, "z", at(60))], [ended("z", "z", 0, "z", at(61))]),
             ([begun("z", 0, "y", at(90))], [ended("y", "z", 0, "y", at(91))])]
    rows = []
    for k, (s, r) in enumerate(steps):
        write(tmp_path / "starts", str(k), s)
        write(tmp_path / "results", str(k), r)
        read = lambda name, schema: spark.readStream.schema(schema).json(str(tmp_path / name) + "/*.jsonl")
        joined = progress.matched_results(read("starts", "device string, pid long, key string, started timestamp"),
                                          read("results", "message string, device string, pid long, status string, finished timestamp"))
        query = (joined.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
                 .foreachBatch(lambda b, _: rows.extend((x.device, x.pid, x.key, x.status) for x in b.collect())).start())  # a restart each time
        query.awaitTermination(120)
        assert query.exception() is None
    want = [("a", 1, "j1", "success"), ("a", 1, "j2", "timeout"), ("b", 2, "k2", "success"), ("a", 9, None, "lost"), ("b", 2, None, "early")]
    assert sorted((x for x in rows if x[0] != "z"), key=str) == sorted(want, key=str)
