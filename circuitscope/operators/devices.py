"""Device catalogs: compact profiles, full records, statistics of instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S


def sorted_edges(edges: DataFrame) -> DataFrame:
    """(device_id, edges): distinct directed edges in order. All-to-all devices have no row: ``all_to_all`` says so, no edges do not."""
    return edges.groupBy("device_id").agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("edges"))


def number_summary(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """count, min, mean and max of the finite values; a group without any has count 0 and nulls."""
    x = S.finite_or_null(F.col(column))
    return rows.groupBy(*keys).agg(F.count(x).alias("count"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"))


def instruction_properties(instructions: DataFrame, properties: DataFrame) -> DataFrame:
    """Instructions with error and duration by name and qubits; unknown ones are null."""
    return instructions.join(properties.select("device_id", "name", "qubits", "error", "duration_seconds"), ["device_id", "name", "qubits"], "left")


def instruction_summary(instructions: DataFrame) -> DataFrame:
    """(device_id, name, errors, durations): summaries by operation, finite values only."""
    stat = lambda c: F.struct(F.count(S.finite_or_null(F.col(c))).alias("count"), F.min(S.finite_or_null(F.col(c))).alias("min"),
                              F.avg(S.finite_or_null(F.col(c))).alias("mean"), F.max(S.finite_or_null(F.col(c))).alias("max"))
    return instructions.groupBy("device_id", "name").agg(stat("error").alias("errors"), stat("duration_seconds").alias("durations"))


def compact_profile(devices: DataFrame, catalog_path: str) -> DataFrame:
    """What a prompt needs of a device, and where the rest is."""
    return devices.select("device_id", F.struct(
        F.col("device_id").alias("id"), "num_qubits", F.array_sort("operation_names").alias("operation_names"), "all_to_all",
        F.concat(F.lit(catalog_path + "#"), F.col("device_id")).alias("catalog_reference")).alias("profile"))


def device_record(devices: DataFrame, edges: DataFrame, instructions: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """One nested record for each device: operations, edges, instructions and their summaries, actions."""
    inst = F.struct("name", "num_qubits", "qubits", S.finite_or_null(F.col("error")).alias("error"), S.finite_or_null(F.col("duration_seconds")).alias("duration_seconds"))
    rows = instructions.groupBy("device_id").agg(F.array_sort(F.collect_list(inst)).alias("instructions"))
    summaries = instruction_summary(instructions).groupBy("device_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("errors", "durations"))))).alias("summaries"))
    out = devices.join(sorted_edges(edges), "device_id", "left").join(rows, "device_id", "left").join(summaries, "device_id", "left")
    parts = ["num_qubits", F.array_sort("operation_names").alias("operation_names"), "all_to_all", "edges", "instructions", "summaries"]
    if actions is not None:
        out = out.join(actions.groupBy("device_id").agg(F.array_sort(F.collect_list(F.struct("index", "name", "origin", "pass_type"))).alias("actions")), "device_id", "left")
        parts.append("actions")
    return out.select("device_id", F.struct(F.col("device_id").alias("id"), *parts).alias("record"))
