"""Recommendation over a table of requests: parse, filter, retrieve, ask, validate, retry; compile only what was confirmed."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from ..operators import compatibility, jobs, qasm, records as R, retrieval, validation

Frame = Callable[[DataFrame], DataFrame]


class Gateway(Protocol):
    """Adds a text column ``response`` to rows with a column ``prompt``."""

    def generate(self, prompts: DataFrame) -> DataFrame: ...


class UnconfiguredGateway:
    def generate(self, prompts: DataFrame) -> DataFrame:
        raise RuntimeError("no gateway is configured")


@dataclass(frozen=True)
class CallableGateway:
    """Wraps a function from a DataFrame with ``prompt`` to one with ``response``."""

    function: Frame

    def generate(self, prompts: DataFrame) -> DataFrame:
        return self.function(prompts)


class NoCompatibleDevice(Exception):
    pass


class AttemptsExhausted(Exception):
    """Carries (request_id, attempts, errors) of what was never valid."""

    def __init__(self, failed: DataFrame):
        super().__init__("some requests have no valid recommendation")
        self.failed = failed


class ConfirmationRequired(Exception):
    pass


@dataclass
class Service:
    """Ports are plain functions and can be replaced one by one."""

    devices: DataFrame
    examples: DataFrame
    gateway: Gateway = field(default_factory=UnconfiguredGateway)
    max_attempts: int = 2
    n_examples: int = 3
    answers: str | None = None
    parse: Frame = qasm.parse_each
    validate: Frame = validation.validate

    def __post_init__(self):
        if self.max_attempts < 1 or self.n_examples < 0:
            raise ValueError("max_attempts must be 1 or more, n_examples 0 or more")

    def prepare(self, requests: DataFrame) -> DataFrame:
        """Requests with features, available devices and examples. Bad circuits keep their problem."""
        parsed = qasm.feature_map(qasm.features(self.parse(requests.withColumnRenamed("qasm2", "qasm"))))
        parsed = parsed.withColumn("operation_names", F.array_sort(F.array_distinct(F.transform("ops", lambda o: o["op"]))))
        report = compatibility.report(parsed, self.devices)
        profile = F.struct(F.col("device_id").alias("id"), *[c for c in ("num_qubits", "operation_names", "coupling_edges", "metadata") if c in self.devices.columns])
        hardware = (report.select("request_id", F.explode("available").alias("device_id"))
                    .join(jobs.broadcast_if_small(self.devices.select("device_id", profile.alias("__profile"))), "device_id")
                    .groupBy("request_id").agg(F.array_sort(F.collect_list("__profile")).alias("hardware")))
        ready = parsed.join(report, "request_id", "left").join(hardware, "request_id", "left")
        near = retrieval.nearest_examples(ready, self.examples, self.n_examples).groupBy("request_id").agg(
            F.array_sort(F.collect_list(F.struct("rank", "record_id", "distance", "prompt_input")), lambda a, b: a["rank"] - b["rank"]).alias("examples"))
        return ready.join(near, "request_id", "left")

    def _kept(self, answers: DataFrame, attempt: int) -> DataFrame:
        """The answers as a written table: a lost executor reads them again and asks nobody twice."""
        spark = answers.sparkSession
        folder = self.answers or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("name a shared folder for the answers, or set spark.checkpoint.dir")
        path = f"{folder.rstrip('/')}/answers-{uuid.uuid4().hex}-{attempt}"
        answers.write.parquet(path)
        return spark.read.schema(answers.schema).parquet(path)

    def answer_each(self, requests: DataFrame) -> DataFrame:
        """(request_id, status, attempt, recommendation, errors), a row for every request, whatever becomes of the others.

        ``status``: ``answered``; ``bad_circuit`` with the parser's problem as its error, or ``no_compatible_device``, of which nobody is asked; ``attempts_exhausted``
        with the last errors. What was prepared is written once, and so is each attempt's answer, before it is judged. Only whether a request is
        still open comes to the driver; each attempt asks again for what is still invalid, with its errors.
        """
        return self._asked(self._judged(requests))

    def _judged(self, requests: DataFrame) -> DataFrame:
        """What was prepared, written once, with the status of requests of which nobody is asked."""
        none = F.coalesce(F.size("available"), F.lit(0)) <= 0
        refused = F.when(F.col("problem").isNotNull(), "bad_circuit").when(none, "no_compatible_device")
        return self._kept(self.prepare(requests).withColumn("__status", refused), 0).withColumn("__errors", F.lit(None).cast("array<string>"))

    def _asked(self, judged: DataFrame) -> DataFrame:
        kind = "struct<selected_device:string,figure_of_merit:string,plan:struct<optimization_level:bigint,seed_transpiler:bigint,layout_method:string,routing_method:string>,explanation:string,evidence:array<string>,warnings:array<string>>"
        closed = lambda rows, status, attempt, errors: rows.select(
            "request_id", status.alias("status"), F.lit(attempt).alias("attempt"), F.lit(None).cast(kind).alias("recommendation"), errors.alias("errors"))
        out = closed(judged.where("__status IS NOT NULL"), F.col("__status"), 0, F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(F.array().cast("array<string>")))
        pending = judged.where("__status IS NULL").drop("__status")
        for attempt in range(1, self.max_attempts + 1):
            if pending.isEmpty():
                return out
            circuit = F.struct(F.col("circuit_name").alias("name"), F.lit("OpenQASM 2").alias("format"), F.col("qasm").alias("qasm2"), "num_qubits", "depth", "operation_names", "features")
            request = F.struct("request_id", "user_text", "figure_of_merit", "constraints", circuit.alias("circuit"))
            prompts = pending.withColumn("prompt", R.prompt_payload(request, F.col("hardware"), F.col("unavailable"), F.col("examples"), F.col("__errors"), F.col("figure_of_merit"), F.col("available")))
            answered = self.validate(self._kept(self.gateway.generate(prompts), attempt)).withColumn("attempt", F.lit(attempt))
            out = out.unionByName(answered.where("is_valid").select("request_id", F.lit("answered").alias("status"), "attempt", F.col("recommendation").cast(kind), "errors"))
            pending = answered.where("not is_valid").select(*[c for c in judged.columns if c not in ("__errors", "__status")], F.col("errors").alias("__errors"))
        return out.unionByName(closed(pending, F.lit("attempts_exhausted"), self.max_attempts, F.col("__errors")))

    def recommend(self, requests: DataFrame) -> DataFrame:
        """(request_id, attempt, recommendation) of every request, or an error that carries the failures; :meth:`answer_each` has a row for each instead."""
        judged = self._judged(requests)
        if not judged.where("__status IS NOT NULL").isEmpty():
            raise NoCompatibleDevice("requests without a device or with a bad circuit")
        rows = self._asked(judged)
        open_ = rows.where("status = 'attempts_exhausted'")
        if not open_.isEmpty():
            raise AttemptsExhausted(open_.select("request_id", F.col("attempt").alias("attempts"), "errors"))
        return rows.select("request_id", "attempt", "recommendation")


def approved(recommendations: DataFrame, approvals: DataFrame) -> DataFrame:
    """Stored recommendations that were approved: what the client sends back is never used beyond its id. Every approval must be
    confirmed and name a stored request."""
    if not approvals.where(~F.coalesce("confirmed", F.lit(False))).isEmpty():
        raise ConfirmationRequired("an approval is not confirmed")
    if not approvals.join(recommendations, "request_id", "left_anti").isEmpty():
        raise KeyError("an approval names no stored request")
    return recommendations.join(approvals.select("request_id"), "request_id", "left_semi")


def latest_recommendations(history: DataFrame) -> DataFrame:
    """Last write by request: ``history`` has a growing ``version``."""
    rest = [c for c in history.columns if c != "request_id"]
    return history.groupBy("request_id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("request_id", "r.*")


def ui_response(recommendations: DataFrame) -> DataFrame:
    return recommendations.select("request_id", F.to_json(F.struct("request_id", "attempt", "recommendation", F.lit(True).alias("requires_confirmation"))).alias("response"))
