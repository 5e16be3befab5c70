"""Counts taken in the write against counts of what was written."""

import pytest
from pyspark.sql import functions as F

from circuitscope.operators import jobs as J, sampling
from circuitscope.sources import observed


def test_counts_are_those_of_what_was_written(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.range(0, 1000, 1, 7).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("d"), (F.col("id") % 4).cast("string"))).alias("label"))
    seen = observed.write_counted(rows.repartition(5, "label"), path, F.col("label"), ["d0", "d1", "d2", "d9", "d0"], F.col("id") > 99)
    back = spark.read.parquet(path)
    counts = {r.label: r["count"] for r in back.where("id > 99").groupBy("label").count().collect()}
    assert (seen.n, seen.chosen) == (1000, 900) and back.count() == 1000
    assert seen.by_label == {"d0": counts["d0"], "d1": counts["d1"], "d2": counts["d2"], "d9": 0} and seen.elsewhere == counts["d3"] + counts[None]
    assert seen.smallest() is None
    assert observed.Seen(3, 3, {"a": 2, "b": 1, "c": 0}, 0).smallest() == 1


@pytest.mark.parametrize("source", ["parquet", "json"])
def test_empty_tables_and_null_choices(spark, tmp_path, source):
    none = spark.createDataFrame([], "id long, label string")
    seen = observed.write_counted(none, str(tmp_path / "none"), F.col("label"), ["a"], source=source)
    assert seen == observed.Seen(0, 0, {"a": 0}, 0) and seen.smallest() is None
    odd = spark.createDataFrame([(1, "a"), (None, "a"), (2, None)], "id long, label string")
    assert observed.write_counted(odd, str(tmp_path / "odd"), F.col("label"), ["a"], F.col("id") > 0, source) == observed.Seen(3, 2, {"a": 1}, 1)
    assert observed.write_counted(odd, str(tmp_path / "free"), F.col("label"), [], source=source).elsewhere == 3
    with pytest.raises(ValueError, match="labels"):
        observed.write_counted(odd, str(tmp_path / "many"), F.col("label"), [str(k) for k in range(observed.MAX_LABELS + 1)])
    assert not (tmp_path / "many").exists()


def test_balance_by_a_known_smallest_class(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") < 20, "a").otherwise("b").alias("label"))
    for strategy in ("none", "undersample", "cap-ratio"):
        counted, known = (sampling.balance(rows, "label", "id", strategy, 2.0, 4, smallest) for smallest in (None, 20))
        assert sorted(counted[0].collect()) == sorted(known[0].collect()) and sorted(counted[1].collect()) == sorted(known[1].collect())


def test_queue_of_a_device_with_one_width(spark):
    """One device and width is numbered in pieces: cut points may be any, positions are those of the order, nulls first."""
    names = [None, "", "same", *(f"c{k * 7919 % 5000:04}" for k in range(5000))]
    jobs = spark.createDataFrame([("d", 3, name, str(k)) for k, name in enumerate(names)], "device string, num_qubits int, circuit string, key string")
    got = {int(r.key): r.position for r in J.device_queues(jobs).collect()}
    want = sorted(range(len(names)), key=lambda k: (names[k] is not None, names[k] or ""))
    assert [got[k] for k in want] == list(range(1, len(names) + 1))
    assert 32 < jobs.select(J.ordered_part(jobs, "circuit").alias("p")).distinct().count() <= 65
    assert J.device_queues(jobs.limit(0)).count() == 0
