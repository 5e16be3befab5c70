"""Which devices a request may use, with reasons for those that it may not."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import jobs


def classify(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """(request_id, device_id, reasons, available): each request with each device of the catalog, as the result wants.

    Reasons in order: ``excluded_by_user`` where the request lists allowed devices and not this one;
    ``insufficient_qubits:needed>has``. An empty or null list allows all.
    """
    catalog = jobs.broadcast_if_small(devices.select("device_id", F.col("num_qubits").alias("__has")))
    listed = F.size(F.coalesce("allowed_devices", F.array().cast("array<string>"))) > 0
    reasons = F.array_compact(F.array(
        F.when(listed & ~F.array_contains("allowed_devices", F.col("device_id")), F.lit("excluded_by_user")),
        F.when(F.col("num_qubits") > F.col("__has"), F.concat(F.lit("insufficient_qubits:"), F.col("num_qubits").cast("string"), F.lit(">"), F.col("__has").cast("string")))))
    return requests.crossJoin(catalog).select("request_id", "device_id", reasons.alias("reasons")).withColumn("available", F.size("reasons") == 0)


def unknown_devices(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """(request_id, device_id, reasons) for allowed devices that the catalog lacks."""
    asked = requests.select("request_id", F.explode("allowed_devices").alias("device_id")).distinct()
    return asked.join(devices.select("device_id"), "device_id", "left_anti").select("request_id", "device_id", F.array(F.lit("not_in_hardware_catalog")).alias("reasons"))


def report(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """(request_id, available, unavailable): sorted device ids, and device to reasons."""
    known = classify(requests, devices)
    rows = known.select("request_id", "device_id", "reasons").unionByName(unknown_devices(requests, devices))
    free = F.collect_list(F.when(F.size("reasons") == 0, F.col("device_id")))
    bad = F.collect_list(F.when(F.size("reasons") > 0, F.struct("device_id", "reasons")))
    return rows.groupBy("request_id").agg(F.array_sort(free).alias("available"), F.map_from_entries(F.array_sort(bad)).alias("unavailable"))
