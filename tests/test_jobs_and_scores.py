"""The log, jobs, labels, samples, retrieval, validation and plans on hand-made tables."""

import json
import math

import pytest
from pyspark.sql import Row, functions as F

from circuitscope import schemas
from circuitscope.functions import scalars as S
from circuitscope.operators import compatibility, devices as D, jobs as J, qasm, records as R, retrieval, sampling, scores as C, selector_model, validation
from circuitscope.plans import device_selector, recommend, strict_export
from circuitscope.sources import readers, writers


def log(spark, *lines):
    rows = spark.createDataFrame([(k, x if isinstance(x, str) else json.dumps(x)) for k, x in enumerate(lines)], "line_no long, value string")
    return readers.parse_manifest(rows), rows


def test_log_kinds_latest_and_attempts(spark):
    good, raw = log(spark, {"key": "a|d", "status": "success", "mode": "rl", "attempt": 1}, {"key": "a|d", "status": "running", "attempt": 3}, '{"key": "a|d", "sta', [1],
                    {"key": 5, "status": "failed"}, {"key": "b|d", "attempt": True}, {"key": "c|d", "status": "success", "fallback_reason": None})
    assert [(r.line_no, r.reason) for r in readers.malformed_lines(raw).orderBy("line_no").collect()] == [(2, "not_json"), (3, "not_an_object"), (4, "key_not_a_string")]
    latest = {r.key: r for r in J.latest_records(good).collect()}
    assert latest["a|d"].status == "success" and latest["b|d"].status is None and set(latest) == {"a|d", "b|d", "c|d"}
    assert {r.key: (r.attempts, r.status) for r in J.attempts_and_status(good).collect()} == {"a|d": (3, "running"), "b|d": (1, None), "c|d": (0, "success")}
    assert [r.key for r in J.latest_records(good).where(J.strict_success()).collect()] == ["a|d"]  # a null fallback key still is one


@pytest.mark.parametrize("record, ok", [
    ({"status": "success", "mode": "rl"}, True), ({"status": "success"}, True), ({"status": "success", "mode": None}, True), ({"status": "success", "mode": "fallback"}, False),
    ({"status": "success_fallback", "mode": "fallback", "fallback_reason": "x"}, False), ({"status": "success_recovered_after_timeout", "phase": "rl"}, True),
    ({"status": "success_recovered_after_timeout"}, False), ({"mode": "rl"}, False)])
def test_strict_success(spark, record, ok):
    assert log(spark, {"key": "k"} | record)[0].select(J.strict_success().alias("x")).first().x is ok


def scores(spark, *rows):
    return spark.createDataFrame(rows, "circuit string, device string, device_pos int, score double")


def test_label_guards_and_ties(spark):
    got = {r.circuit: r.label for r in C.best_device(scores(
        spark, ("ok", "a", 0, 0.25), ("ok", "b", 1, -1.0), ("ok", "c", 2, 0.8), ("none", "a", 0, -1.0), ("none", "b", 1, None), ("nan", "a", 0, math.nan), ("nan", "b", 1, 0.1),
        ("nan", "c", 2, math.inf), ("tie", "z", 0, 0.5), ("tie", "a", 1, 0.5))).collect()}
    assert got == {"ok": "c", "none": None, "nan": "b", "tie": "z"}
    ranked = C.selection_margin(scores(spark, ("tie", "z", 0, 0.5), ("tie", "a", 1, 0.5), ("one", "a", 0, 0.3), ("one", "b", 1, math.nan))).collect()
    assert {r.circuit: (r.device, r.margin) for r in ranked} == {"tie": ("a", 0.0), "one": ("a", None)}


def test_pairs_with_and_without_broadcast(spark, monkeypatch):
    circuits = spark.createDataFrame([(f"c{n}", n) for n in range(0, 70, 3)], "name string, num_qubits int")
    catalog = spark.createDataFrame([(f"d{n}", n) for n in (1, 5, 27, 64)], "device_id string, device_qubits int")
    small = {tuple(r) for r in J.fitting_pairs(circuits, catalog).collect()}
    monkeypatch.setattr(J, "MAX_BROADCAST_DEVICES", 1)
    assert {tuple(r) for r in J.fitting_pairs(circuits, catalog).select("name", "num_qubits", "device_id", "device_qubits").collect()} == small
    assert len(small) == sum(c <= d for c in range(0, 70, 3) for d in (1, 5, 27, 64))


def jobs(spark):
    circuits = spark.createDataFrame([("small", 2), ("wide", 5), ("huge", 99)], "name string, num_qubits int")
    catalog = spark.createDataFrame([("d2", 2, 0), ("d9", 9, 1)], "device_id string, num_qubits int, device_pos int")
    return circuits, catalog, J.build_jobs(circuits, catalog, "expected_fidelity", "src", "out")


def test_jobs_pending_queues_coverage(spark):
    _, _, j = jobs(spark)
    assert sorted(r.key for r in j.collect()) == ["small|d2", "small|d9", "wide|d9"]
    assert j.where("key = 'wide|d9'").first().output == "out/wide_expected_fidelity-d9.qasm"
    valid = spark.createDataFrame([("small|d2",)], "key string")
    attempts = spark.createDataFrame([("wide|d9", 2)], "key string, attempts int")
    pending = J.pending_jobs(j, valid, attempts, 2)
    assert [r.key for r in pending.collect()] == ["small|d9"]
    assert {r.circuit: r.complete for r in J.coverage(j, valid).collect()} == {"small": False, "wide": False}
    assert {r.circuit: r.complete for r in J.coverage(j, j.select("key")).collect()} == {"small": True, "wide": True}
    assert {r.device: r.n_missing for r in J.missing_by_device(j, valid).collect()} == {"d2": 0, "d9": 2}
    assert {r.key for r in J.first_circuits(j, 1).collect()} == {"small|d2", "small|d9"}
    assert {r.key for r in J.one_job_per_device(j).collect()} == {"small|d2", "small|d9"}
    assert [(r.device, r.position, r.key) for r in J.device_queues(j).orderBy("device", "position").collect()] == [("d2", 1, "small|d2"), ("d9", 1, "small|d9"), ("d9", 2, "wide|d9")]


def test_changed_outputs(spark):
    before = spark.createDataFrame([("same", 1, 10), ("grown", 1, 10)], "key string, modified int, size int")
    now = spark.createDataFrame([("same", 1, 10, True), ("grown", 1, 11, True), ("new", 1, 1, True), ("bad", 2, 2, False)], "key string, modified int, size int, valid boolean")
    assert {r.key for r in J.changed_outputs(before, now).collect()} == {"grown", "new"}


def test_numbers_and_strings(spark):
    x = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (None,)], "x double")
    assert [r.y for r in x.select(S.finite_or_null(F.col("x")).alias("y")).collect()] == [1.0, None, None, None]
    assert tuple(D.number_summary(x.withColumn("k", F.lit(1)), ["k"], "x").first()) == (1, 1, 1.0, 1.0, 1.0)
    assert tuple(D.number_summary(x.where("isnan(x)").withColumn("k", F.lit(1)), ["k"], "x").first()) == (1, 0, None, None, None)
    row = spark.range(1).select(S.is_blank(F.lit("  \t")).alias("b"), S.truncated_int(F.lit("2.9")).alias("i"), S.is_close(F.lit(1.0), F.lit(1.0 + 1e-9)).alias("c"),
                                S.portable_path(F.lit("/r/a/b"), "/r").alias("p"), S.share_element(F.array(F.lit(None).cast("string")), F.array(F.lit("a"))).alias("s")).first()
    assert tuple(row) == (True, 2, True, "a/b", False)
    with pytest.raises(Exception):
        writers.require_finite(x, "x").collect()


def test_cap_and_split(spark):
    rows = spark.createDataFrame([(k, "a" if k < 4 else "b") for k in range(40)], "id int, label string")
    capped = sampling.cap_classes(rows, "label", "id", 2.5, seed=3)
    assert {r.label: r["count"] for r in capped.groupBy("label").count().collect()} == {"a": 4, "b": 10}
    assert sampling.cap_classes(rows, "label", "id", 2.5, seed=3).collect() == capped.collect()
    import hashlib

    want = sorted(range(4, 40), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:10]
    assert {r.id for r in capped.where("label = 'b'").collect()} == set(want)
    assert sampling.cap_classes(rows.limit(0), "label", "id", 2.0).count() == 0
    assert [r.id for r in sampling.cap_rows(rows, "id", 5, 3, "id").collect()] == sorted(sorted(range(40), key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:5])


def test_rejections_and_minimum(spark):
    rows = spark.createDataFrame([(i, f"n{i}", "x" if i % 3 else ("y" if i else None)) for i in range(12)], "idx int, name string, reason string")
    got = R.rejection_report(rows, "reason", "name", "idx", 3).collect()
    assert [(r.reason, r.n, r.examples) for r in got] == [("x", 8, ["n1", "n2", "n4"]), ("y", 3, ["n3", "n6", "n9"])]


@pytest.mark.parametrize("cell, problem", [
    (None, "missing_compilation"), (("fallback", "success", ["terminate"]), "mode_fallback"), (("rl", "failed", ["terminate"]), "status_failed"), (("rl", "success", []), "empty_pass_trace"),
    (("rl", "success", ["fallback:1", "terminate"]), "fallback_pass_in_trace"), (("rl", "success", ["a"]), "trace_without_terminal_action"), (("rl", "success", ["a", "terminate"]), None)])
def test_trace_problems(spark, cell, problem):
    row = spark.createDataFrame([(cell,)], "c struct<mode:string,status:string,passes:array<string>>")
    assert row.select(R.trace_problem(F.col("c")).alias("p")).first().p == problem


def test_compatibility_reasons(spark):
    requests = spark.createDataFrame([("r", 2, None), ("s", 2, ["two", "gone"])], "request_id string, num_qubits int, allowed_devices array<string>")
    catalog = spark.createDataFrame([("one", 1), ("two", 2)], "device_id string, num_qubits int")
    got = {r.request_id: r for r in compatibility.report(requests, catalog).collect()}
    assert got["r"].available == ["two"] and got["r"].unavailable == {"one": ["insufficient_qubits:2>1"]}
    assert got["s"].unavailable == {"gone": ["not_in_hardware_catalog"], "one": ["excluded_by_user", "insufficient_qubits:2>1"]}


RECORD = ("struct<objective:struct<name:string,direction:string>,user_constraints:map<string,string>,circuit:struct<name:string,qasm2:string,summary:map<string,string>,"
          "features:struct<by_name:map<string,double>>>,compatible_backends:array<struct<id:string,num_qubits:int,operation_names:array<string>>>>")


def record(features, device="d", metric="m"):
    return ((metric, "max"), {}, ("n", "SECRET QASM", {"depth": "3"}, (features,)), [(device, 5, ["h"])])


def test_retrieval_order_eligibility_and_leaks(spark):
    records = spark.createDataFrame([("far", record({"x": 9.0, "extra": 1.0})), ("b", record({"x": 1.0})), ("a", record({"x": 1.0})), ("no_feature", record({"y": 1.0})),
                                     ("other_device", record({"x": 1.0}, "z")), ("other_metric", record({"x": 1.0}, metric="q")), ("nan", record({"x": math.nan})), ("null", None)],
                                    f"record_id string, input {RECORD}")
    asked = spark.createDataFrame([("r", "m", {"x": 1.0}, ["d"])], "request_id string, figure_of_merit string, features map<string,double>, available array<string>")
    got = retrieval.nearest_examples(asked, records, 3).orderBy("rank").collect()
    assert [(r.record_id, r.distance) for r in got] == [("a", 0.0), ("b", 0.0), ("far", 0.8)]
    assert "SECRET" not in str(got) and got[0].prompt_input.compatible_backends[0].operation_names == ["h"]
    retrieval.MAX_REQUESTS, most = 1, retrieval.MAX_REQUESTS
    try:
        many = asked.union(asked.withColumn("request_id", F.lit("s")))
        assert [(r.request_id, r.record_id) for r in retrieval.nearest_examples(many, records, 3).orderBy("request_id", "rank").collect()] == [(x, y) for x in "rs" for y in ("a", "b", "far")]
    finally:
        retrieval.MAX_REQUESTS = most
    assert retrieval.nearest_examples(asked, records, 0).count() == 0


GOOD = {"selected_device": "d", "figure_of_merit": "m", "compiler": "qiskit", "explanation": "e", "evidence": [" x "],
        "qiskit_plan": {"optimization_level": 1, "seed_transpiler": 2**32 - 1, "layout_method": None, "routing_method": "sabre"}}


def validated(spark, response, constraints="{}"):
    rows = spark.createDataFrame([(response if isinstance(response, str) else json.dumps(response), ["d"], "m", constraints)], "response string, available array<string>, figure_of_merit string, constraints string")
    return validation.validate(rows).first()


def test_valid_plan(spark):
    row = validated(spark, GOOD)
    assert row.is_valid and row.recommendation.evidence == ["x"] and row.recommendation.plan.seed_transpiler == 2**32 - 1 and row.recommendation.warnings == []


@pytest.mark.parametrize("change, constraints, word", [
    ({"selected_device": "e"}, "{}", "selected_device"), ({"figure_of_merit": "x"}, "{}", "figure_of_merit"), ({"compiler": "t"}, "{}", "compiler"), ({"explanation": "  "}, "{}", "explanation"),
    ({"evidence": None}, "{}", "evidence"), ({"evidence": ["ok", 1]}, "{}", "evidence"), ({"warnings": "w"}, "{}", "warnings"),
    ({"qiskit_plan": GOOD["qiskit_plan"] | {"optimization_level": True}}, "{}", "optimization_level"), ({"qiskit_plan": GOOD["qiskit_plan"] | {"optimization_level": 1.0}}, "{}", "optimization_level"),
    ({"qiskit_plan": GOOD["qiskit_plan"] | {"seed_transpiler": 2**32}}, "{}", "seed"), ({"qiskit_plan": GOOD["qiskit_plan"] | {"layout_method": ["trivial"]}}, "{}", "layout"),
    ({"qiskit_plan": GOOD["qiskit_plan"] | {"routing_method": "x"}}, "{}", "routing"), ({}, '{"max_optimization_level": 0}', "exceeds"), ({}, '{"max_optimization_level": false}', "exceeds")])
def test_one_broken_rule(spark, change, constraints, word):
    errors = validated(spark, GOOD | change, constraints).errors
    assert len(errors) == 1 and word in errors[0]


def test_no_object_and_no_plan(spark):
    assert validated(spark, "[1]").errors == validated(spark, "{bad").errors == ["response must be a JSON object"]
    assert len(validated(spark, GOOD | {"qiskit_plan": 3}).errors) == 3


def test_selector_plan_end_to_end(spark):
    circuits, catalog, j = jobs(spark)
    manifest, _ = log(spark, {"key": "small|d2", "status": "success", "mode": "rl", "attempt": 1, "passes": ["a", "terminate"]}, {"key": "small|d9", "status": "failed", "attempt": 2})
    compiled = spark.createDataFrame([("small|d2", "text", True)], "key string, qasm string, valid boolean")
    raw = spark.createDataFrame([("small", "d2", 0.9), ("small", "d9", 0.95)], "circuit string, device string, score double")
    feats = spark.createDataFrame([("small", {"x": 1.0}), ("wide", {"x": 2.0})], "circuit string, features map<string,double>")
    t = device_selector.build(circuits, catalog, manifest, compiled, raw, feats)
    sample = t.samples.collect()
    assert [(r.circuit, r.label, r.scores) for r in sample] == [("small", "d2", {"d2": 0.9, "d9": -1.0})]  # a score without a strict success does not count
    assert [r.key for r in t.pending.collect()] == ["wide|d9"]
    assert device_selector.inconsistencies(t.cells, t.samples).count() == 0
    assert {(r.circuit, r.device): r.mode for r in t.cells.collect()}[("wide", "d2")] == "incompatible_num_qubits"
    out = device_selector.export_records(t.cells, t.samples).first()
    assert out["index"] == 0 and out.compiled_circuits["d2"].used_for_score


def test_index_is_dense(spark):
    rows = device_selector.with_index(spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 1000).alias("v")), "v", "i").orderBy("i").collect()
    assert [r.i for r in rows] == list(range(500)) and [r.v for r in rows] == sorted(r.v for r in rows)


def test_strict_export(spark, tmp_path):
    circuits = spark.createDataFrame([(0, "ok", "t", 2, {"num_qubits": 2.0}), (1, "bad", "t", 2, {"num_qubits": 2.0}), (2, "odd", "t", 3, {"num_qubits": 2.0}), (3, "lost", None, 2, {"num_qubits": 2.0})],
                                     "idx int, name string, qasm string, num_qubits int, features map<string,double>")
    cell = ("rl", "success", "q", ["a", "terminate"])
    rows = [("ok", "d1", 0, 0.5, 0.5, cell, True, True), ("ok", "d2", 1, 0.7, 0.7, cell, True, True), ("ok", "d3", 2, -1.0, None, None, False, None),
            ("bad", "d1", 0, 0.5, 0.6, cell, True, True), ("bad", "d2", 1, 0.5, 0.5, None, True, True), ("odd", "d1", 0, 0.5, 0.5, cell, True, True)]
    cells = spark.createDataFrame(rows, "circuit string, device string, device_pos int, score double, recomputed double, compilation struct<mode:string,status:string,qasm:string,passes:array<string>>, fits boolean, executable boolean")
    labels = spark.createDataFrame([("ok", "d2"), ("bad", "d1"), ("odd", "d1")], "circuit string, label string")
    built = strict_export.build(circuits, cells, labels, ["num_qubits"])
    assert {r.circuit: r.reason for r in built.collect()} == {"ok": None, "bad": "score_mismatch", "odd": "width_mismatch", "lost": "source_missing"}
    assert strict_export.build(circuits, cells, labels, ["num_qubits"], legacy_score_rule=True).where("circuit = 'ok'").first().reason == "missing_compilation"
    kept = strict_export.select_records(built, 3.0, max_records=5)
    parsed = qasm.parse(spark.createDataFrame([("ok", 'OPENQASM 2.0; qreg q[2]; h q[0]; rz(2*theta) q[0]; cx q[0],q[1];')], "name string, qasm string"))
    catalog = spark.createDataFrame([("d1", 3, ["cx", "h"]), ("d2", 5, ["cx"]), ("d3", 1, ["x"])], "device_id string, num_qubits int, operation_names array<string>")
    records = strict_export.to_records(kept, qasm.summary(parsed), catalog, ["num_qubits"])
    out = records.first()
    assert out.expected_output.selected_device == "d2" and out.deterministic_ground_truth.selection_margin == pytest.approx(0.2)
    assert [b.id for b in out.input.compatible_backends] == ["d1", "d2"] and out.input.circuit.summary.num_parameters == 1
    _, report = sampling.balance(built.where("reason is null"), "label", "record_id")
    head = strict_export.header(built, kept, report, "cap-ratio", ["num_qubits"]).first()
    assert (head.source_sample_count, head.strict_eligible_count, head.exported_record_count) == (4, 1, 1) and head.label_distribution == {"d2": 1}
    assert head.rejection_counts == {"score_mismatch": 1, "width_mismatch": 1, "source_missing": 1} and head.balance.before == {"d2": 1}
    # what is exported can be read back and retrieved, and shows no target
    writers.write_records(records, str(tmp_path / "records"))
    back = readers.read_context_records(spark, str(tmp_path / "records"))
    asked = spark.createDataFrame([("r", "expected_fidelity", {"num_qubits": 3.0}, ["d1"])], "request_id string, figure_of_merit string, features map<string,double>, available array<string>")
    found = retrieval.nearest_examples(asked, back, 3).collect()
    assert [(r.record_id, r.distance) for r in found] == [(out.record_id, 0.25)] and found[0].prompt_input.circuit.summary["depth"] == "3"
    assert not any(word in str(found) for word in ("candidate_outcomes", "selection_margin", "expected_output", "terminate"))


def test_feature_vector_names_and_counts(spark):
    row = qasm.feature_map(qasm.features(qasm.parse(spark.createDataFrame([("a", 'OPENQASM 2.0; qreg q[2]; h q; cx q[0],q[1]; barrier q;')], "name string, qasm string")))).first()
    assert len(qasm.FEATURE_NAMES) == len(set(qasm.FEATURE_NAMES)) == 49 and set(row.features) == set(qasm.FEATURE_NAMES)
    assert {k: v for k, v in row.features.items() if v and k.startswith("gate")} == {"gate_count_h": 2.0, "gate_count_cx": 1.0} and row.features["num_qubits"] == 2.0


def test_publishing(spark, tmp_path):
    source, target = tmp_path / "a", tmp_path / "b"
    source.mkdir(), target.mkdir()
    (source / "x.zip").write_text("1"), (source / "y.zip").write_text("2"), (source / "z.txt").write_text("3"), (target / "y.zip").write_text("other")
    plan = {r.name: r.action for r in writers.publish(spark, str(source), str(target), "*.zip", dry_run=True).collect()}
    assert plan == {"x.zip": "copy", "y.zip": "conflict"} and not (target / "x.zip").exists()
    with pytest.raises(FileExistsError):
        writers.publish(spark, str(source), str(target), "*.zip")
    assert not (target / "x.zip").exists()
    assert {r.name for r in writers.publish(spark, str(source), str(target), "*.zip", overwrite=True).collect()} == {"x.zip", "y.zip"}
    assert (target / "y.zip").read_text() == "2" and sorted(p.name for p in target.iterdir() if p.suffix == ".zip") == ["x.zip", "y.zip"]


def test_recommendation_retries_then_needs_confirmation(spark):
    catalog = spark.createDataFrame([("d", 5)], "device_id string, num_qubits int")
    examples = spark.createDataFrame([], f"record_id string, input {RECORD}")
    request = spark.createDataFrame([Row(request_id="r", user_text="u", qasm2='OPENQASM 2.0; qreg q[2]; h q[0]; cx q[0],q[1];', circuit_name="c", figure_of_merit="m", constraints="{}")]).withColumn(
        "allowed_devices", F.lit(None).cast("array<string>"))
    seen = []

    def answer(prompts):
        seen.append(prompts.first().prompt)
        return prompts.withColumn("response", F.lit(json.dumps(GOOD | ({} if len(seen) > 1 else {"selected_device": "other"}))))

    service = recommend.Service(catalog, examples, recommend.CallableGateway(answer))
    found = service.recommend(request)
    prompt = json.loads(seen[0])
    assert prompt["live_request"]["request"]["circuit"]["operation_names"] == ["cx", "h"] and prompt["live_request"]["request"]["circuit"]["features"]["gate_count_cx"] == 1.0
    assert [d["id"] for d in prompt["live_request"]["compatible_hardware"]] == ["d"] and prompt["rules"] and "sabre" in prompt["response_contract"]["qiskit_plan"]["layout_method"]
    assert found.first().attempt == 2 and "selected_device is not" in json.loads(seen[1])["previous_validation_errors"][0]
    approvals = spark.createDataFrame([("r", False)], "request_id string, confirmed boolean")
    with pytest.raises(recommend.ConfirmationRequired):
        recommend.approved(found, approvals)
    assert recommend.approved(found, approvals.withColumn("confirmed", F.lit(True))).count() == 1
    with pytest.raises(KeyError):
        recommend.approved(found, spark.createDataFrame([("x", True)], "request_id string, confirmed boolean"))
    with pytest.raises(RuntimeError):
        recommend.Service(catalog, examples).recommend(request)
    with pytest.raises(recommend.AttemptsExhausted):
        recommend.Service(catalog, examples, recommend.CallableGateway(lambda p: p.withColumn("response", F.lit("no"))), max_attempts=1).recommend(request)
    with pytest.raises(recommend.NoCompatibleDevice):
        recommend.Service(catalog.where("num_qubits < 2"), examples).recommend(request)


def test_each_request_has_an_answer_of_its_own(spark):
    catalog = spark.createDataFrame([("d", 2, 0, ["h", "cx"])], "device_id string, num_qubits int, device_pos int, operation_names array<string>")
    examples = spark.createDataFrame([], f"record_id string, input {schemas.CONTEXT_RECORD.split('input:', 1)[1].rsplit('>', 1)[0]}")
    text = lambda body: f"OPENQASM 2.0; qreg q[2]; {body}"
    rows = [("good", text("h q[0];")), ("broken", text("cx q[0];")), ("wide", "OPENQASM 2.0; qreg q[9]; h q;"), ("silent", text("h q[1];"))]
    requests = spark.createDataFrame([(k, "", q, k, "expected_fidelity", None, None) for k, q in rows], schemas.REQUESTS)
    plan = json.dumps({"selected_device": "d", "figure_of_merit": "expected_fidelity", "compiler": "qiskit", "explanation": "e", "evidence": ["x"], "warnings": [],
                       "qiskit_plan": {"optimization_level": 1, "seed_transpiler": 7, "layout_method": None, "routing_method": "sabre"}})
    gateway = recommend.CallableGateway(lambda p: p.withColumn("response", F.when(F.col("request_id") == "good", plan).otherwise("no")))
    service = recommend.Service(catalog, examples, gateway, max_attempts=2)
    got = {r.request_id: r for r in service.answer_each(requests).collect()}
    assert {k: (r.status, r.attempt, r.errors) for k, r in got.items()} == {
        "good": ("answered", 1, []), "broken": ("bad_circuit", 0, ["wrong_arity"]), "wide": ("no_compatible_device", 0, []),
        "silent": ("attempts_exhausted", 2, ["response must be a JSON object"])}
    assert got["good"].recommendation.plan.seed_transpiler == 7 and got["silent"].recommendation is None
    assert service.answer_each(requests.limit(0)).count() == 0


def test_rounding_by_the_exact_value(spark):
    import random

    rng = random.Random(5)
    values = [1.0005, 0.1235, 1.2345, 8.0025, 0.0625, 0.1875, -0.0625, -1.0005, 0.0, 2.5e-4, 1e15 + 0.3, 123456789.0005, -3.4565] + [rng.randint(-10**7, 10**7) / 10**4 for _ in range(500)] + [
        rng.uniform(-1, 1) * 10 ** rng.randint(-4, 9) for _ in range(500)] + [rng.randint(-4000, 4000) / 16 for _ in range(100)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.round3(F.col("v")).alias("r")).collect()
    assert [(r.v, r.r) for r in got] == [(v, round(v, 3)) for v in values]


def test_devices_and_documents(spark, tmp_path):
    catalog = spark.createDataFrame([("b", 2), ("a", 3), ("a", 3)], "device_id string, num_qubits int")
    assert [r.device_id for r in readers.list_devices(catalog, ["b", "a", "b"]).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        readers.list_devices(catalog, ["zz"])
    assert readers.read_context_dataset(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception):
        readers.read_context_dataset(spark, str(tmp_path / "none.json"), required=True)
    writers.write_document({"b": 1, "a": 2}, str(tmp_path / "x" / "doc.json"))
    assert (tmp_path / "x" / "doc.json").read_text().index('"a"') < (tmp_path / "x" / "doc.json").read_text().index('"b"')
    with pytest.raises(ValueError):
        writers.write_document({"b": math.nan}, str(tmp_path / "x" / "doc.json"))
    (tmp_path / "m.csv").write_text("# {}\nr,l,t\n1.5,3,0.2\n")
    assert tuple(readers.read_monitor(spark, str(tmp_path / "m.csv")).first()) == (1.5, 3, 0.2)
    (tmp_path / "w.log").write_text("x job=a|d azione_RL=p1 y\nnothing\nx job=a|d azione_RL=terminate\n")
    assert [tuple(r) for r in readers.read_actions(spark, str(tmp_path / "w.log")).orderBy("key", "step").collect()] == [("a|d", 1, "p1"), ("a|d", 2, "terminate")]


def test_model_plan_and_small_fit(spark, tmp_path):
    assert len(selector_model.grid()) == 216
    assert (selector_model.plan(10, 5), selector_model.plan(100, 1), selector_model.plan(100, 3), selector_model.plan(100, 50)) == (("small", 200), ("small", 200), ("search", 3), ("search", 5))
    rows = spark.createDataFrame([(f"c{k}", float(k % 2), float(k), "a" if k % 2 else "b") for k in range(24)], "circuit string, x double, y double, label string")
    model = selector_model.train(rows, ["x", "y"], options={"numTrees": (5,), "maxDepth": (3, 4)})
    loaded = selector_model.save_checked(model, str(tmp_path / "model"), sampling.balanced_weights(rows, "label"))
    got = loaded.transform(sampling.balanced_weights(rows, "label"))
    assert got.where("prediction = label_index").count() == 24


def test_a_small_old_file_comes_before_a_large_new_one(spark, tmp_path):
    import os

    line = lambda status, attempt: json.dumps({"key": "k", "status": status, "attempt": attempt}) + "\n"
    (tmp_path / "a.jsonl").write_text(line("success", 2) * 5000 + line("success", 3))
    (tmp_path / "b.jsonl").write_text(line("timeout", 1))
    os.utime(tmp_path / "b.jsonl", (1_000_000_000, 1_000_000_000))
    log = readers.read_manifest(spark, str(tmp_path))
    assert [(r.status, r.attempt) for r in J.latest_records(log).collect()] == [("success", 3)]
    assert [(r.attempts, r.status) for r in J.attempts_and_status(log).collect()] == [(3, "success")]


def test_ranks_over_many_tasks(spark):
    rows = spark.createDataFrame([("a" if k % 10 else None if k % 20 else "b", k * 37 % 1000) for k in range(600)], "g string, v int").repartition(7)
    got = J.ranked_within(rows, "g", ["v"], F.floor(F.col("v") / 50), "r").collect()
    for g in ("a", "b", None):
        own = sorted((r.v, r.r) for r in got if r.g == g)
        assert [r for _, r in own] == list(range(1, len(own) + 1))


def test_balance_strategies_and_failures(spark):
    rows = spark.createDataFrame([("a", k) for k in range(9)] + [("b", 100 + k) for k in range(2)], "label string, id int")
    counts = lambda t: {r.label: (r.before, r.after) for r in t.collect()}
    assert counts(sampling.balance(rows, "label", "id", "none")[1]) == {"a": (9, 9), "b": (2, 2)}
    assert counts(sampling.balance(rows, "label", "id", "undersample")[1]) == {"a": (9, 2), "b": (2, 2)}
    assert counts(sampling.balance(rows, "label", "id", "cap-ratio", 3.0)[1]) == {"a": (9, 6), "b": (2, 2)}
    with pytest.raises(ValueError):
        sampling.balance(rows, "label", "id", "other")
    scores = spark.createDataFrame([("x", 0.5), ("x", -1.0), ("y", -1.0)], "circuit string, score double")
    assert C.require_labels(scores) == 1
    with pytest.raises(ValueError):
        C.require_labels(scores.where("circuit = 'y'"))
