"""The nearest rows and examples against brute force: copies, ties, numbers that are none, more blocks than one."""

import math

import numpy as np
import pytest

from circuitscope.operators import retrieval


def brute(query, rows, k):
    distance = lambda v: sum(abs(a - b) / (1 + max(abs(a), abs(b))) for a, b in zip(query, v)) / len(query)
    return sorted(((distance(v), i) for i, v in rows), key=lambda x: (math.isnan(x[0]), x))[:k]


@pytest.mark.parametrize("most", [1 << 16, 300])
def test_nearest_rows_of_many(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "MAX_REQUESTS", most)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-4, 5, 3)]) for i in range(2500)] + [(2500, [math.nan, 0.0, 1.0]), (2501, None), (2502, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in retrieval.nearest_rows_each(table.where("vec_id % 50 = 0"), table, "embedding", "vec_id", 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    whole = [(i, v) for i, v in rows if i < 2500]
    assert {q: got[q] for q in got if q < 2500} == {i: brute(v, whole, 4) for i, v in whole if i % 50 == 0}
    assert [i for _, i in got[2500]] == [0, 1, 2, 3]  # all at a distance that is no number, itself too


def test_nearest_examples_of_many(spark):
    record = ("struct<objective:struct<name:string,direction:string>,user_constraints:map<string,string>,circuit:struct<name:string,qasm2:string,summary:map<string,string>,"
              "features:struct<by_name:map<string,double>>>,compatible_backends:array<struct<id:string,num_qubits:int,operation_names:array<string>>>>")
    features = [(float(i % 17), float(i % 23)) for i in range(1500)]
    records = spark.createDataFrame([(i, (("m", "max"), {}, ("n", "", {}, ({"x": x, "y": y},)), [("d" if i % 2 else "e", 5, [])])) for i, (x, y) in enumerate(features)], f"record_id long, input {record}")
    asked = [(f"q{j}", {"x": j * 1.7, "y": j * 0.9} if j % 3 else {"y": j * 0.9}, ["d"] if j % 2 else ["d", "e", None]) for j in range(40)] + [("none", {}, ["e"]), ("unknown", {"z": 1.0}, ["e"])]
    requests = spark.createDataFrame([(r, "m", f, a) for r, f, a in asked], "request_id string, figure_of_merit string, features map<string,double>, available array<string>")
    got = {}
    for r in retrieval.nearest_examples(requests, records, 3).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append((r.distance, r.record_id))
    want = {"none": [(0.0, 0), (0.0, 2), (0.0, 4)]}
    for r, f, a in asked[:40]:
        open_to = [(i, [{"x": x, "y": y}[n] for n in sorted(f)]) for i, (x, y) in enumerate(features) if ("d" if i % 2 else "e") in a]
        want[r] = brute([f[n] for n in sorted(f)], open_to, 3)
    assert got == want


def test_blocks_meet_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MIN_BLOCK", 10)
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(200)], "vec_id long, embedding array<double>")
    found = retrieval.nearest_rows_each(rows, rows, "embedding", "vec_id", 2)
    assert found.count() == 400
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and f"{2 * retrieval.MIN_BLOCKS})" in plan
