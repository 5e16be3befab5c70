"""The store that a stream fills: lookups are the same before, during and after a merge; what fails changes nothing."""

import random

import pytest

from circuitscope.plans import recommend
from circuitscope.sources import copies
from circuitscope.streaming.versions import VersionedStore, keep_recommendations

KIND = "request_id string, score int, note string"


def filled(spark, root, batches=6, keys=40, seed=3):
    draw, store, history = random.Random(seed), VersionedStore(spark, str(root), "request_id", bucket_rows=10), []
    for n in range(batches):
        rows = [(f"r{draw.randrange(keys)}", draw.randrange(100), None) for _ in range(15)]
        store.append(spark.createDataFrame(rows, KIND), n)
        history += [(k, max(s for key, s, _ in rows if key == k), n) for k in {r[0] for r in rows}]
    return store, history


def state(store):
    return sorted((r.request_id, r.score, r.version) for r in store.latest().collect())


def expected(history):
    last = {}
    for key, score, version in history:
        last[key] = (key, score, version)
    return sorted(last.values())


def test_lookups_before_during_and_after_a_merge(spark, tmp_path, monkeypatch):
    store, history = filled(spark, tmp_path)
    want = expected(history)
    assert state(store) == want
    plain = spark.createDataFrame([(k, s, v) for k, s, v in history], "request_id string, score int, version long")
    assert sorted((r.request_id, r.score, r.version) for r in recommend.latest_recommendations(plain).collect()) == want
    seen = []
    switch = copies.replace_file
    monkeypatch.setattr(copies, "replace_file", lambda *a: (seen.append(state(store)), switch(*a)))
    assert store.merge()
    assert seen == [want] and state(store) == want and store.merge() is None
    store.append(spark.createDataFrame([("r1", -5, "new"), ("other", 1, None)], KIND), 6)
    want = expected(history + [("r1", -5, 6), ("other", 1, 6)])
    assert state(store) == want
    assert [(r.score, r.note, r.version) for r in store.lookup("r1").collect()] == [(-5, "new", 6)]
    assert store.merge(whole=True) and state(store) == want
    gone = store.drop_merged()
    assert len([g for g in gone if g.startswith("batches/")]) == 7 and len([g for g in gone if g.startswith("runs/")]) == 1
    assert state(store) == want and not store.lookup("nobody").collect()


def test_a_lookup_reads_its_buckets_only(spark, tmp_path):
    store, history = filled(spark, tmp_path, batches=8, keys=80)
    store.merge(whole=True), store.drop_merged()
    for key, score, version in expected(history)[::7]:
        found = store.lookup(key)
        assert [(r.score, r.version) for r in found.collect()] == [(score, version)]
    assert len(found.inputFiles()) > 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    with pytest.raises(ValueError):
        store.lookup(*map(str, range(1001)))


def test_a_merge_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    store, history = filled(spark, tmp_path, batches=3)

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(copies, "replace_file", fails)
    with pytest.raises(OSError):
        store.merge()
    monkeypatch.undo()
    assert state(store) == expected(history)
    assert store.merge() and state(store) == expected(history)
    assert [g.split("/")[0] for g in store.drop_merged()].count("runs") == 1  # what the failed merge left


def test_runs_grow_and_a_repeated_batch_is_stored_once(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), "request_id")
    with pytest.raises(FileNotFoundError):
        store.latest()
    big = spark.range(400).selectExpr("cast(id as string) request_id", "cast(id as int) score", "cast(null as string) note")
    store.append(big, 0), store.merge()
    for n in (1, 2):
        store.append(spark.createDataFrame([(str(n), 1000, None)], KIND), n)
        store.merge()
    sizes = [r["rows"] for r in store._current()["runs"]]
    assert sizes == [2, 400]  # the small runs met, the large one was left alone
    store.append(spark.createDataFrame([("1", -1, None)], KIND), 1)  # merged already
    store.append(spark.createDataFrame([("3", 7, None)], KIND), 3)
    store.append(spark.createDataFrame([("3", 8, None)], KIND), 3)  # committed already
    got = {r.request_id: r.score for r in store.lookup("1", "2", "3", "4").collect()}
    assert got == {"1": 1000, "2": 1000, "3": 7, "4": 4}


def test_a_stream_fills_it_and_goes_on(spark, tmp_path):
    source, store = tmp_path / "in", VersionedStore(spark, str(tmp_path / "store"), "request_id")
    source.mkdir()
    for n, score in enumerate((5, 9, 2)):
        spark.createDataFrame([("a", score, None), (f"b{n}", score, None)], KIND).coalesce(1).write.mode("append").json(str(source))
        keep_recommendations(spark.readStream.schema(KIND).json(str(source)), store, str(tmp_path / "ck")).awaitTermination()
        if n == 1:
            store.merge(), store.drop_merged()
    assert state(store) == [("a", 2, 2), ("b0", 5, 0), ("b1", 9, 1), ("b2", 2, 2)]
