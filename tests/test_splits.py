"""Splits without leakage, paired comparison and held-out scores of the selector."""

import random

from pyspark.sql import functions as F

from circuitscope.operators import qasm, sampling, scores as C, selector_model


def test_groups_stay_whole_and_classes_have_their_shares(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for g in range(400):
        label = rng.choice("aab")
        for _ in range(rng.randint(1, 9)):
            rows.append((n, g if g else None, label if rng.random() < 0.9 else "c"))
            n += 1
    table = spark.createDataFrame(rows, "circuit long, family long, label string")
    got = sampling.group_split(table, "family", "label").collect()
    assert sorted((r.circuit, r.family, r.label) for r in got) == sorted(rows)
    sides = {}
    for r in got:
        sides.setdefault(r.family, set()).add(r.side)
    assert all(len(s) == 1 for s in sides.values()) and None in sides
    for label in "ab":
        own = [r.side for r in got if r.label == label]
        for side, share in (("train", 0.7), ("validation", 0.1), ("test", 0.2)):
            assert abs(own.count(side) / len(own) - share) < 0.04
    again = sampling.group_split(table.repartition(7), "family", "label").collect()
    assert {(r.circuit, r.side) for r in again} == {(r.circuit, r.side) for r in got}
    assert sampling.group_split(table.limit(0), "family", "label").count() == 0
    assert {r.side for r in sampling.group_split(table, "family", "label", {"all": 1.0}).collect()} == {"all"}


def test_outcomes_and_regret(spark):
    scores = spark.createDataFrame([("c1", "a", 0.5), ("c1", "b", 0.7), ("c2", "a", 0.9), ("c2", "b", -1.0), ("c3", "a", None), ("c3", "b", 0.1), ("c4", "a", float("nan")), ("c4", "b", None),
                                    ("c5", "a", 0.30), ("c5", "b", 0.31), ("c5", "z", 0.9)], "circuit string, device string, score double")
    choices = spark.createDataFrame([(f"c{k}", "a", "b") for k in range(1, 7)], "circuit string, first string, second string")
    got = {r.circuit: (r.outcome, None if r.regret is None else round(r.regret, 9)) for r in C.paired_outcomes(scores, choices, 0.05).collect()}
    assert got == {"c1": ("loss", 0.2), "c2": ("win", 0.0), "c3": ("loss", None), "c4": ("tie", None), "c5": ("tie", 0.6), "c6": ("tie", None)}
    row = C.comparison(C.paired_outcomes(scores, choices, 0.05)).first()
    assert (row.n, row.wins, row.ties, row.losses, row.failures, round(row.max_regret, 9)) == (6, 1, 3, 2, 3, 0.6)


def test_circuits_that_differ_in_parameters_only_are_one_group(spark):
    head = "OPENQASM 2.0; qreg q[2]; "
    rows = spark.createDataFrame([("a", head + "rz(1) q[0]; cx q[0],q[1];"), ("b", head + "rz(2) q[0]; cx q[0],q[1];"), ("c", head + "rz(1) q[0]; cx q[1],q[0];")], "name string, qasm string")
    keys = {r.name: r.k for r in qasm.parse(rows).select("name", qasm.sequence_key().alias("k")).collect()}
    assert keys["a"] == keys["b"] != keys["c"]


def test_held_out_scores_of_the_selector(spark):
    rows = [(f"c{k}", f"g{k // 2}", float(k % 2), "a" if k % 2 else "b") for k in range(60)]
    samples = spark.createDataFrame(rows, "circuit string, family string, x double, label string")
    scores = samples.select("circuit", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("device"), "label").select("circuit", "device", F.when(F.col("device") == F.col("label"), 0.9).otherwise(0.4).alias("score"))
    model, tested, confusion, report = selector_model.train_held_out(samples, ["x"], "family", scores, "a", options={"numTrees": (5,), "maxDepth": (3,)})
    r = report.first()
    assert {(x.label, x.predicted) for x in confusion.collect()} == {("a", "a"), ("b", "b")}
    assert r.n == tested.count() > 5 and r.wins == r.ties == r.n / 2 and r.losses == 0 and r.max_regret == 0.0
