"""Examples for a recommender: only circuits all of whose compatible devices have a verified learned trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..operators import jobs as J, records as R, sampling, scores as C
from ..sources.observed import Seen


def cell_problems(cells: DataFrame, legacy_score_rule: bool = False) -> DataFrame:
    """``cells`` (circuit, device, device_pos, score, recomputed, compilation, fits, executable) and problem, outcome.

    A device is compatible if the circuit fits it; with ``legacy_score_rule`` if its score is not null, which
    also takes in devices that are too narrow, since these carry the score of a failure.
    """
    compatible = F.col("score").isNotNull() if legacy_score_rule else F.col("fits")
    problem, outcome = R.candidate(F.col("compilation"), F.col("device"), F.col("score"), F.col("recomputed"))
    if "file_problem" in cells.columns:  # of :func:`.verified_cells.verified_cells`: what is wrong with the file says more than its score
        problem = F.coalesce(R.trace_problem(F.col("compilation")), F.col("file_problem"), problem)
    problem = F.coalesce(problem, F.when(~F.coalesce("executable", F.lit(False)), "not_executable"))
    return cells.where(compatible).withColumns({"problem": problem, "outcome": outcome})


#: The checks of a circuit in their order; those of its cells (:func:`cell_problems`) come before the last.
CHECKS = ("source_missing", "feature_set_mismatch", "feature_not_finite", "width_mismatch", "no_compatible_device", "label_argmax_mismatch")


def build(circuits: DataFrame, cells: DataFrame, labels: DataFrame, feature_names: list[str], metric: str = "expected_fidelity",
          legacy_score_rule: bool = False, name_devices: bool = False) -> DataFrame:
    """One row for each circuit (name, qasm, num_qubits, features, idx): reason (null if eligible), record_id, label, ranking, margin, outcomes.

    Checks in order: the source, its features, its devices in catalog order, then that the label is rank 1. With ``name_devices`` the reason of a
    device begins with its name and a colon.
    """
    rated = cell_problems(cells, legacy_score_rule)
    if name_devices:
        rated = rated.withColumn("problem", F.concat("device", F.lit(":"), "problem"))
    first = rated.groupBy("circuit").agg(
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("device_pos"))).alias("cell_problem"),
        F.array_sort(F.collect_list(F.when(F.col("problem").isNull(), F.col("outcome")))).alias("outcomes"), F.count("*").alias("n_candidates"),
        F.transform(F.array_sort(F.collect_list(F.struct("device_pos", "device"))), lambda c: c["device"]).alias("candidates"))
    ranked = C.rank_devices(rated.where("problem is null"))
    ranking = ranked.groupBy("circuit").agg(F.array_sort(F.collect_list(F.struct("rank", "device", "score"))).alias("ranking"))
    margin = ranked.where("rank = 1").select("circuit", F.col("device").alias("best"), (F.col("score") - F.col("next_score")).alias("margin"))
    joined = (circuits.withColumnRenamed("name", "circuit").join(labels.select("circuit", "label"), "circuit", "left").join(first, "circuit", "left")
              .join(ranking, "circuit", "left").join(margin, "circuit", "left"))
    expected = F.array(*[F.lit(f) for f in feature_names])
    wrong_features = ~F.coalesce(S.same_elements(F.map_keys("features"), expected), F.lit(False))
    not_finite = ~F.forall(F.map_values("features"), lambda x: F.coalesce(S.is_finite(x), F.lit(False)))
    broken = dict(zip(CHECKS, (
        F.col("qasm").isNull(), wrong_features, not_finite, F.try_element_at("features", F.lit("num_qubits")).cast("int") != F.col("num_qubits"), F.col("n_candidates").isNull())))
    reason = F.coalesce(*[F.when(b, name) for name, b in broken.items()], F.col("cell_problem"), F.when(~F.col("label").eqNullSafe(F.col("best")), CHECKS[-1]))
    return joined.select("idx", "circuit", "num_qubits", reason.alias("reason"), S.record_id(F.lit(metric), F.col("circuit"), F.col("qasm")).alias("record_id"),
                         "label", "ranking", "margin", "outcomes", F.sha2("qasm", 256).alias("sha256"), "features", "qasm", "candidates")


def select_records(built: DataFrame, ratio: float, seed: int = 0, max_records: int | None = None) -> DataFrame:
    """Eligible circuits, classes capped, then at most ``max_records``, in input order."""
    chosen = sampling.cap_classes(built.where("reason is null"), "label", "record_id", ratio, seed)
    return sampling.cap_rows(chosen, "record_id", max_records, seed, "idx") if max_records is not None else chosen.orderBy("idx")


#: Figures of merit: which way is better, and what our operators compute under the name.
METRICS = {"expected_fidelity": ("maximize", "prod(1 - error) over the compiled operations, from the device table"),
           "critical_depth": ("maximize", "1 - (two-qubit gates on a longest path) / (two-qubit gates)")}
#: What each section of a record is for.
SECTIONS = {"input": "prompt", "expected_output": "target", "deterministic_ground_truth": "evaluation"}


def to_records(selected: DataFrame, summaries: DataFrame, devices: DataFrame, feature_names: list[str], metric: str = "expected_fidelity") -> DataFrame:
    """(record_id, input, expected_output, deterministic_ground_truth): three separate sections, of which only ``input`` may be shown.

    ``summaries``: of :func:`circuitscope.operators.qasm.summary`. ``devices``: device_id, num_qubits, operation_names and, where known, the
    columns coupling_map, instruction_error_summary, instruction_duration_summary, allowed_compilation_actions. Written as
    JSON lines, the result is read back by :func:`circuitscope.sources.readers.read_context_records`.
    """
    optional = [c for c in ("coupling_map", "instruction_error_summary", "instruction_duration_summary", "allowed_compilation_actions") if c in devices.columns]
    profile = F.struct(F.col("device_id").alias("id"), "num_qubits", "operation_names", *optional)
    catalog = devices.select(F.col("device_id").alias("__device"), profile.alias("__profile"))
    backends = (selected.select("circuit", F.posexplode("candidates").alias("__pos", "__device")).join(J.broadcast_if_small(catalog), "__device")
                .groupBy("circuit").agg(F.array_sort(F.collect_list(F.struct("__pos", "__profile"))).alias("__b"))
                .select("circuit", F.transform("__b", lambda b: b["__profile"]).alias("backends")))
    facts = summaries.select(F.col("name").alias("circuit"), F.struct("num_qubits", "num_clbits", "depth", "size", F.col("op_counts").alias("operation_counts"), "num_parameters").alias("summary"))
    rows = selected.join(backends, "circuit", "left").join(facts, "circuit", "left")
    names = F.array(*[F.lit(n) for n in feature_names])
    direction, meaning = METRICS.get(metric, ("maximize", ""))
    own = F.try_element_at(F.filter("outcomes", lambda o: o["device"] == F.col("label")), F.lit(1))
    capacity = F.try_element_at(F.transform(F.filter("backends", lambda b: b["id"] == F.col("label")), lambda b: b["num_qubits"]), F.lit(1))
    fact = lambda claim, *evidence: F.struct(claim.alias("claim"), F.array(*evidence).alias("evidence"))
    at_label = lambda head, tail: F.concat(F.lit(head), F.col("label"), F.lit(tail))
    facts_of = F.array(
        fact(F.concat_ws(" ", F.lit("width:"), F.col("num_qubits").cast("string"), F.lit("<="), capacity.cast("string")),
             F.lit("input.circuit.summary.num_qubits"), at_label("input.compatible_backends[id=", "].num_qubits")),
        fact(F.concat_ws(" ", F.lit(f"{metric}: rank 1 of"), F.size("ranking").cast("string")), F.lit("deterministic_ground_truth.device_ranking"), F.lit("deterministic_ground_truth.selection_margin")),
        fact(F.concat_ws(" ", F.lit("trace:"), F.size(own["compilation_passes"]).cast("string"), F.lit("passes")), at_label("deterministic_ground_truth.candidate_outcomes[device=", "]")))
    return rows.select(
        "record_id",
        F.struct(
            F.struct(F.lit(metric).alias("name"), F.lit(direction).alias("direction")).alias("objective"),
            F.create_map().cast("map<string,string>").alias("user_constraints"),
            F.struct(F.col("circuit").alias("name"), F.lit("OpenQASM 2").alias("format"), "sha256", F.col("qasm").alias("qasm2"), "summary",
                     F.struct(F.lit(len(feature_names)).alias("feature_count"), names.alias("ordered_names"), F.transform(names, lambda n: F.try_element_at("features", n)).alias("ordered_values"),
                              F.col("features").alias("by_name")).alias("features")).alias("circuit"),
            F.col("backends").alias("compatible_backends"),
            F.struct(F.lit("string").alias("selected_device"), F.lit("array<string>").alias("compilation_passes"),
                     F.lit("array<struct<claim:string,evidence:array<string>>>").alias("reasons"), F.lit("array<string>").alias("warnings")).alias("response_contract")).alias("input"),
        F.struct(
            F.col("label").alias("selected_device"), F.lit("qiskit").alias("compiler"), own["compilation_passes"].alias("compilation_passes"),
            facts_of.alias("reasons"),
            F.array(F.lit(meaning)).alias("warnings")).alias("expected_output"),
        F.struct(F.lit(f"argmax({metric}) over width-compatible devices").alias("selection_rule"), F.col("ranking").alias("device_ranking"), F.col("margin").alias("selection_margin"),
                 F.col("outcomes").alias("candidate_outcomes"), F.lit(False).alias("fallback_examples_included")).alias("deterministic_ground_truth"))


def header(built: DataFrame, selected: DataFrame, balance_report: DataFrame, strategy: str, feature_names: list[str], metric: str = "expected_fidelity",
           seen: Seen | None = None, exported: Seen | None = None) -> DataFrame:
    """One row about an export: counts, how it was balanced, its labels, and why circuits were rejected, with examples.

    ``seen`` and ``exported`` are what the writes of ``built`` and ``selected`` counted; without them these are scanned.
    """
    if seen is None:
        counts = built.agg(F.count("*").alias("source_sample_count"), F.count_if(F.col("reason").isNull()).alias("strict_eligible_count"))
    else:
        counts = built.sparkSession.createDataFrame([(seen.n, seen.chosen)], "source_sample_count long, strict_eligible_count long")
    if exported is not None and not exported.elsewhere:
        found = {name: n for name, n in exported.by_label.items() if n}
        labels = built.sparkSession.createDataFrame([(exported.n, found)], "exported_record_count long, label_distribution map<string,long>")
    else:
        labels = selected.groupBy("label").agg(F.count("*").alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("exported_record_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_distribution"))
    as_map = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", value))))
    balanced = balance_report.agg(F.struct(F.lit(strategy).alias("strategy"), as_map("before").alias("before"), as_map("after").alias("after"),
                                           F.coalesce(F.sum(F.col("before") - F.col("after")), F.lit(0)).alias("discarded_for_balance")).alias("balance"))
    rejected = R.rejection_report(built, "reason", "circuit", "idx").agg(
        F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("rejection_counts"), F.map_from_entries(F.collect_list(F.struct("reason", "examples"))).alias("rejection_examples"))
    one = counts.crossJoin(labels).crossJoin(balanced).crossJoin(rejected)  # a row each
    return one.select("*", F.lit(metric).alias("figure_of_merit"), F.lit(len(feature_names)).alias("feature_count"), F.array(*[F.lit(n) for n in feature_names]).alias("ordered_names"),
                      F.lit("rejected by: " + ", ".join(CHECKS)).alias("eligibility_rule"), F.lit("; ".join(f"{k}: {v}" for k, v in SECTIONS.items())).alias("usage_rule"))
