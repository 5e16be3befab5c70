"""The command line over small tables."""

import json

import pytest

from circuitscope.__main__ import main
from circuitscope.operators import qasm, sampling
from circuitscope.plans import strict_export
from circuitscope.sources import readers

BELL = 'OPENQASM 2.0; include "qelib1.inc"; qreg q[2]; h q[0]; cx q[0],q[1];'


@pytest.fixture
def tables(spark, tmp_path):
    (tmp_path / "circuits").mkdir()
    for name in ("bell", "other"):
        (tmp_path / "circuits" / f"{name}.qasm").write_text(BELL)
    (tmp_path / "log.jsonl").write_text("".join(json.dumps({"key": f"{n}|d", "status": "success", "mode": "rl", "attempt": 1, "passes": ["a", "terminate"]}) + "\n" for n in ("bell",)))
    save = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / name))
    save("devices", [("d", 5, ["cx", "h"], 0)], "device_id string, num_qubits int, operation_names array<string>, device_pos int")
    save("compiled", [("bell|d", BELL, True)], "key string, qasm string, valid boolean")
    save("scores", [("bell", "d", 0.5)], "circuit string, device string, score double")
    cell = ("rl", "success", BELL, ["a", "terminate"])
    save("cells", [("bell", "d", 0, 0.5, 0.5, cell, True, True)], "circuit string, device string, device_pos int, score double, recomputed double, "
         "compilation struct<mode:string,status:string,qasm:string,passes:array<string>>, fits boolean, executable boolean")
    save("labels", [("bell", "d")], "circuit string, label string")
    return tmp_path


def test_select(spark, tables):
    at = lambda n: str(tables / n)
    main(["select", "--circuits", at("circuits"), "--devices", at("devices"), "--log", at("log.jsonl"), "--compiled", at("compiled"), "--scores", at("scores"), "--out", at("out")], spark)
    row = spark.read.json(at("out/records")).first()
    assert (row.circuit, row.label_device, row["index"]) == ("bell", "d", 0) and len(row.features) == 49
    assert [r.key for r in spark.read.json(at("out/pending")).collect()] == ["other|d"]


def test_export(spark, tables):
    at = lambda n: str(tables / n)
    given = ["export", "--circuits", at("circuits"), "--cells", at("cells"), "--labels", at("labels"), "--devices", at("devices")]
    main([*given, "--out", at("audit"), "--audit-only"], spark)
    assert not (tables / "audit" / "records").exists()
    main([*given, "--out", at("out")], spark)
    head, record = spark.read.json(at("out/header")).first(), spark.read.json(at("out/records")).first()
    assert head.source_sample_count == 2 and head.exported_record_count == 1 and head.ordered_names == list(qasm.FEATURE_NAMES)
    assert record.input.circuit.name == "bell" and record.expected_output.selected_device == "d"
    with pytest.raises(SystemExit):
        main([*given, "--out", at("few"), "--minimum-per-device", "2"], spark)


def test_export_reads_its_circuits_once(spark, tables, monkeypatch):
    """Rows of circuits are counted as they are read; the header's counts, taken while writing, equal those of scans."""
    read, scan = spark.sparkContext.accumulator(0), readers.scan_circuits

    def counted(*given):
        def see(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch
        rows = scan(*given)
        return rows.mapInArrow(see, rows.schema)

    monkeypatch.setattr(readers, "scan_circuits", counted)
    at = lambda n: str(tables / n)
    main(["export", "--circuits", at("circuits"), "--cells", at("cells"), "--labels", at("labels"), "--devices", at("devices"), "--out", at("once")], spark)
    assert read.value == 2
    built = spark.read.parquet(at("once/eligibility"))
    kept, report = sampling.balance(built.where("reason is null"), "label", "record_id", "cap-ratio", 3.0)
    scanned = strict_export.header(built, kept, report, "cap-ratio", list(qasm.FEATURE_NAMES)).first().asDict(recursive=True)
    told = spark.read.json(at("once/header")).first().asDict(recursive=True)
    assert all(told[k] == scanned[k] for k in ("source_sample_count", "strict_eligible_count", "exported_record_count", "label_distribution", "balance", "rejection_counts"))


def test_export_refuses_repeated_names(spark, tables, monkeypatch):
    scan = readers.scan_circuits
    monkeypatch.setattr(readers, "scan_circuits", lambda *given: scan(*given).union(scan(*given)))
    at = lambda n: str(tables / n)
    with pytest.raises(ValueError, match="2 rows repeat name"):
        main(["export", "--circuits", at("circuits"), "--cells", at("cells"), "--labels", at("labels"), "--devices", at("devices"), "--out", at("twice")], spark)
    assert not (tables / "twice" / "header").exists()


def test_export_from_compiled_files(spark, tables):
    """From folders of circuit text to records: files are read, checked, scored again, and refused for what is wrong with them."""
    head = 'OPENQASM 2.0; include "qelib1.inc"; qreg q[3]; '
    files = {"bell": {"d": "h q[0]; cx q[0],q[1];", "e": "h q[0]; cx q[0],q[1];"}, "off": {"d": "cx q[0],q[2];"}, "odd": {"d": "rz(1) q[0];"}, "bad": {"d": "cx q[0];"}, "low": {"d": "h q[0];"},
             "dark": {"d": "h q[2];"}, "fell": {"d": "h q[0];"}}
    (tables / "texts").mkdir(), (tables / "files").mkdir()
    for name, by in files.items():
        (tables / "texts" / f"{name}.qasm").write_text(BELL)
        for device, body in by.items():
            (tables / "files" / f"{name}_expected_fidelity-{device}.qasm").write_text(head + body)
    (tables / "texts" / "gone.qasm").write_text(BELL)
    save = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(str(tables / name))
    save("two", [("d", 3, ["cx", "h"], False, 0), ("e", 3, ["cx", "h"], True, 1), ("tiny", 1, ["h"], True, 2)],
         "device_id string, num_qubits int, operation_names array<string>, all_to_all boolean, device_pos int")
    save("edges", [("d", 0, 1)], "device_id string, src int, dst int")
    save("instructions", [(d, "h", [q], 0.1) for d in "de" for q in (0, 1)] + [(d, "cx", [0, 1], 0.2) for d in "de"] + [("d", "cx", [0, 2], 0.2)], "device_id string, name string, qubits array<int>, error double")
    good = ("rl", "success", ["a", "terminate"])
    cells = [("bell", "d", 0, 0.72, *good), ("bell", "e", 1, 0.72, *good), ("bell", "tiny", 2, -1.0, None, None, None), ("off", "d", 0, 0.8, *good), ("odd", "d", 0, 0.9, *good), ("bad", "d", 0, 0.9, *good),
             ("low", "d", 0, 0.5, *good), ("dark", "d", 0, 0.9, *good), ("gone", "d", 0, 0.9, *good), ("fell", "d", 0, 0.9, "fallback", "success", ["x"])]
    save("stored", cells, "circuit string, device string, device_pos int, score double, mode string, status string, passes array<string>")
    save("best", [(name, "d") for name in [*files, "gone"]], "circuit string, label string")
    at = lambda n: str(tables / n)
    given = ["export", "--circuits", at("texts"), "--cells", at("stored"), "--labels", at("best"), "--devices", at("two"), "--compiled", at("files"), "--edges", at("edges"),
             "--instructions", at("instructions"), "--minimum-per-device", "0", "--out", at("made")]
    main(given, spark)
    reasons = {r.circuit: r.reason for r in spark.read.parquet(at("made/eligibility")).collect()}
    assert reasons == {"bell": None, "off": "d:off_coupling", "odd": "d:unsupported_rz", "bad": "d:unreadable_wrong_arity", "low": "d:score_mismatch", "dark": "d:score_unknown",
                       "gone": "d:no_file", "fell": "d:mode_fallback"}
    record = spark.read.json(at("made/records")).first()
    assert record.expected_output.selected_device == "d" and [x.device for x in record.deterministic_ground_truth.device_ranking] == ["d", "e"]
    assert spark.read.json(at("made/header")).first().rejection_counts["d:no_file"] == 1
    with pytest.raises(SystemExit, match="overwrite"):
        main(given, spark)
    main([*given, "--overwrite"], spark)
