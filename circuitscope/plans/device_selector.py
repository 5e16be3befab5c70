"""From circuits, devices, the log and scores to labelled samples: one declarative plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..operators import jobs as J, records as R, scores as C


@dataclass(frozen=True)
class SelectorTables:
    jobs: DataFrame
    valid_keys: DataFrame
    pending: DataFrame
    coverage: DataFrame
    cells: DataFrame
    samples: DataFrame


def build(circuits: DataFrame, devices: DataFrame, manifest: DataFrame, compiled: DataFrame, scores: DataFrame, features: DataFrame,
          metric: str = "expected_fidelity", max_attempts: int = 2) -> SelectorTables:
    """All tables of a run. ``compiled``: key, qasm, valid. ``scores``: circuit, device, score. Valid work is never redone."""
    jobs = J.build_jobs(circuits, devices, metric, "circuits", "compiled")
    latest = J.latest_records(manifest)
    valid = J.strict_keys(jobs, latest, compiled.where("valid"))
    own = scores.join(jobs.join(valid, "key", "left_semi").select("circuit", "device"), ["circuit", "device"], "left_semi")
    dense = C.dense_scores(jobs, circuits, devices, own)
    mode, status = R.cell_state(F.col("num_qubits"), F.col("capacity"), F.col("status"), F.col("mode"), F.col("valid"))
    cells = (dense.join(circuits.select(F.col("name").alias("circuit"), "num_qubits"), "circuit")
             .join(J.broadcast_if_small(devices.select(F.col("device_id").alias("device"), F.col("num_qubits").alias("capacity"))), "device")
             .withColumn("key", S.job_key(F.col("circuit"), F.col("device")))
             .join(latest.select("key", "status", "mode", "passes", "error"), "key", "left").join(compiled.select("key", "qasm", "valid"), "key", "left")
             .select("circuit", "device", "device_pos", "score", mode.alias("mode"), status.alias("status"), "qasm", "passes", "error",
                     S.valid_score(F.col("score")).alias("used_for_score")))
    return SelectorTables(jobs, valid, J.pending_jobs(jobs, valid, J.attempts_and_status(manifest), max_attempts), J.coverage(jobs, valid), cells,
                          C.labelled_samples(dense, features))


def inconsistencies(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """(circuit, problem): scored cells that are no learned success, and labels that are not the best score's device."""
    unproven = cells.where("used_for_score and not (mode = 'rl' and status like 'success%')").select("circuit", F.lit("score_without_learned_success").alias("problem"))
    best = C.best_device(cells).select("circuit", F.col("label").alias("best"))
    wrong = samples.join(best, "circuit").where(~F.col("label").eqNullSafe(F.col("best"))).select("circuit", F.lit("label_argmax_mismatch").alias("problem"))
    return unproven.union(wrong).distinct()


def export_records(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Nested records in circuit order, with an index from 0."""
    cell = F.struct("mode", "status", "qasm", "passes", "error", "used_for_score")
    table = cells.groupBy("circuit").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("device", cell.alias("c"))))).alias("compiled_circuits"))
    rows = samples.join(table, "circuit").select("circuit", F.col("label").alias("label_device"), "scores", "features", "compiled_circuits")
    return with_index(rows, "circuit", "index")


def with_index(rows: DataFrame, order: str, name: str, parts: int = 64) -> DataFrame:
    """Consecutive numbers from 0 in the order of a column, without one task seeing all rows: each part of the order is numbered on
    its own and shifted by the sizes of those before it."""
    numbered = J.ranked_within(rows.withColumn("__all", F.lit(0)), "__all", [order], J.ordered_part(rows, order, parts), name)
    return numbered.drop("__all").withColumn(name, F.col(name) - 1)
