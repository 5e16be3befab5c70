"""From compiled files to candidates: every cell's file is read, checked against its device and scored again, with a reason where that fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import qasm

#: The metrics that can be computed again from a file.
EXPECTED_FIDELITY, CRITICAL_DEPTH = "expected_fidelity", "critical_depth"


def rescored(compiled: DataFrame, devices: DataFrame, edges: DataFrame, instructions: DataFrame, metric: str = EXPECTED_FIDELITY) -> DataFrame:
    """(circuit, device, qasm, recomputed, executable, file_problem) of every compiled file (circuit, device, qasm, modified).

    Of several files of a cell the newest counts. ``file_problem``, the first of: unreadable_<problem of the parser>, too_wide, unsupported_<operations>,
    off_coupling, score_unknown (an operation without a known error); null if the file is what its device can run.
    """
    if metric not in (EXPECTED_FIDELITY, CRITICAL_DEPTH):
        raise ValueError(f"{metric} can't be computed again")
    newest = compiled.groupBy("circuit", "device").agg(F.max_by("qasm", F.struct("modified", "qasm")).alias("qasm")).withColumnRenamed("circuit", "name")
    parsed = qasm.parse_each(newest)
    capacity = devices.select(F.col("device_id").alias("device"), F.col("num_qubits").alias("__capacity"))
    checked = qasm.verify_compiled(parsed, devices, edges).join(capacity, "device", "left")
    if metric == EXPECTED_FIDELITY:
        scores = qasm.expected_fidelity(parsed.where("problem IS NULL"), instructions)
        # a circuit without operations has no factor, so no row
        met = checked.join(scores, ["name", "device"], "left").withColumn("recomputed", F.when(F.exists("ops", lambda o: o["op"] != "barrier"), F.col("score")).otherwise(F.lit(1.0)))
    else:
        met = qasm.features(checked).withColumn("recomputed", 1 - F.col("critical_depth"))
    problem = (F.when(F.col("problem").isNotNull(), F.concat(F.lit("unreadable_"), "problem")).when(F.col("num_qubits") > F.col("__capacity"), "too_wide")
               .when(F.size("unsupported") > 0, F.concat(F.lit("unsupported_"), F.array_join("unsupported", ","))).when(~F.col("fits_coupling"), "off_coupling")
               .when(F.col("recomputed").isNull(), "score_unknown"))
    return met.select(F.col("name").alias("circuit"), "device", "qasm", F.when(F.col("problem").isNull(), F.col("recomputed")).alias("recomputed"),
                      problem.isNull().alias("executable"), problem.alias("file_problem"))


def verified_cells(cells: DataFrame, circuits: DataFrame, compiled: DataFrame, devices: DataFrame, edges: DataFrame, instructions: DataFrame,
                   metric: str = EXPECTED_FIDELITY) -> DataFrame:
    """``cells`` (circuit, device, device_pos, score, mode, status, passes) as :func:`.strict_export.cell_problems` wants them, from the files themselves.

    Adds compilation (with the file's text), recomputed, executable, fits (by the source circuit's width; ``circuits``: name, num_qubits) and
    file_problem, which is ``no_file`` where a cell has none. Files of no cell are left out.
    """
    found = rescored(compiled, devices, edges, instructions, metric)
    widths = circuits.select(F.col("name").alias("circuit"), F.col("num_qubits").alias("__width"))
    capacity = devices.select(F.col("device_id").alias("device"), F.col("num_qubits").alias("__capacity"))
    joined = cells.join(found, ["circuit", "device"], "left").join(widths, "circuit", "left").join(capacity, "device", "left")
    return joined.select("circuit", "device", "device_pos", "score", "recomputed", F.struct("mode", "status", "qasm", "passes").alias("compilation"),
                         F.coalesce(F.col("__width") <= F.col("__capacity"), F.lit(False)).alias("fits"), F.coalesce("executable", F.lit(False)).alias("executable"),
                         F.when(F.col("qasm").isNull(), "no_file").otherwise(F.col("file_problem")).alias("file_problem"))
