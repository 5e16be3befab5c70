"""Compilation jobs: width-bounded pairs, the log's latest state, what is pending, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S

#: More devices than this are joined without a broadcast.
MAX_BROADCAST_DEVICES = 10_000


def broadcast_if_small(devices: DataFrame) -> DataFrame:
    """The device catalog, broadcast only after a count has shown that it is small."""
    return F.broadcast(devices) if devices.limit(MAX_BROADCAST_DEVICES + 1).count() <= MAX_BROADCAST_DEVICES else devices


def fitting_pairs(circuits: DataFrame, devices: DataFrame, width: str = "num_qubits", capacity: str = "device_qubits") -> DataFrame:
    """Every circuit with every device that has as many qubits: a theta join with the catalog broadcast.

    The catalog's size is checked; a larger one is joined by powers of two of the width, each device under all
    powers up to its own, so that no pair of rows meets that does not come out or share a power.
    """
    condition = F.col(width) <= F.col(capacity)
    if devices.limit(MAX_BROADCAST_DEVICES + 1).count() <= MAX_BROADCAST_DEVICES:
        return circuits.join(F.broadcast(devices), condition)
    level = lambda c: F.floor(F.log2(F.greatest(F.col(c), F.lit(1)))).cast("int")
    levels = devices.withColumn("__level", F.explode(F.sequence(F.lit(0), level(capacity))))
    return circuits.withColumn("__level", level(width)).join(levels, "__level").where(condition).drop("__level")


def build_jobs(circuits: DataFrame, devices: DataFrame, metric: str, source_dir: str, compiled_dir: str) -> DataFrame:
    """Jobs for (name, num_qubits) and devices, with key and paths."""
    catalog = devices.select("device_id", F.col("num_qubits").alias("device_qubits"), "device_pos")
    pairs = fitting_pairs(circuits.select("name", "num_qubits"), catalog)
    return pairs.select(
        F.col("name").alias("circuit"), F.col("device_id").alias("device"), "device_pos", "num_qubits", S.job_key(F.col("name"), F.col("device_id")).alias("key"),
        F.concat(F.lit(source_dir + "/"), "name", F.lit(".qasm")).alias("source"),
        F.concat(F.lit(compiled_dir + "/"), S.compiled_name(F.col("name"), F.lit(metric), F.col("device_id"))).alias("output"))


def job_order() -> list[Column]:
    return [F.col("num_qubits"), F.col("circuit"), F.col("device")]


def first_circuits(jobs: DataFrame, limit: int) -> DataFrame:
    """All jobs of the first ``limit`` circuits by width and name."""
    first = jobs.select("num_qubits", "circuit").distinct().orderBy("num_qubits", "circuit").limit(limit)
    return jobs.join(first, ["num_qubits", "circuit"], "left_semi")


def one_job_per_device(jobs: DataFrame) -> DataFrame:
    """The first job of each device, in job order: a trial before the full run."""
    rank = F.row_number().over(Window.partitionBy("device").orderBy("num_qubits", "circuit"))
    return jobs.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def latest_records(manifest: DataFrame, running: str = "running") -> DataFrame:
    """Each key's last record by place in the log, ``running`` ones aside; a missing status counts as any other."""
    done = manifest.where(F.coalesce("status", F.lit("")) != running)
    rest = [c for c in done.columns if c != "key"]
    return done.groupBy("key").agg(F.max_by(F.struct(*rest), "line_no").alias("r")).select("key", "r.*")


def attempts_and_status(manifest: DataFrame) -> DataFrame:
    """(key, attempts, status): greatest attempt number, and last status that is a string."""
    return manifest.groupBy("key").agg(F.coalesce(F.max("attempt"), F.lit(0)).alias("attempts"),
                                       F.max_by("status", F.when(F.col("status").isNotNull(), F.col("line_no"))).alias("status"))


def strict_success() -> Column:
    """Success by the learned policy itself: no fallback key at all, and mode missing, null or rl; or recovered in that mode."""
    plain = (F.col("status") == "success") & (~F.col("has_mode") | F.col("mode_is_null") | (F.col("mode") == "rl")) & ~F.col("has_fallback")
    recovered = (F.col("status") == "success_recovered_after_timeout") & ((F.col("mode") == "rl") | (F.col("phase") == "rl"))
    return F.coalesce(plain, F.lit(False)) | F.coalesce(recovered, F.lit(False))


def strict_keys(jobs: DataFrame, latest: DataFrame, valid_files: DataFrame) -> DataFrame:
    """Keys of jobs whose latest record is a strict success and whose file is valid: both as semi-joins."""
    return (jobs.join(latest.where(strict_success()).select("key"), "key", "left_semi")
            .join(valid_files.select("key"), "key", "left_semi").select("key"))


def changed_outputs(before: DataFrame, now: DataFrame) -> DataFrame:
    """(key) of valid files whose version (modified, size) differs from an earlier listing, or that it lacks."""
    old = before.select("key", F.struct("modified", "size").alias("__old"))
    new = now.where("valid").select("key", F.struct("modified", "size").alias("__new"))
    return new.join(old, "key", "left").where(~F.col("__new").eqNullSafe(F.col("__old"))).select("key")


def pending_jobs(jobs: DataFrame, valid_keys: DataFrame, attempts: DataFrame, max_attempts: int) -> DataFrame:
    """Jobs that are neither valid nor out of attempts."""
    return (jobs.join(valid_keys.select("key"), "key", "left_anti").join(attempts.select("key", "attempts"), "key", "left")
            .where(F.coalesce("attempts", F.lit(0)) < max_attempts))


def device_queues(pending: DataFrame) -> DataFrame:
    """(device, position, key): each device's queue in job order, numbered without any task seeing all jobs of a device, nor all of one width."""
    piece = F.struct("num_qubits", ordered_part(pending, "circuit"))
    ranked = ranked_within(pending.select("device", "num_qubits", "circuit", "key"), "device", ["num_qubits", "circuit"], piece, "position")
    return ranked.select("device", F.col("position").cast("int").alias("position"), "key")


def ordered_part(rows: DataFrame, order: str, parts: int = 64) -> Column:
    """A number that grows with a column and cuts ``rows`` into about ``parts`` pieces; nulls come first. The cut points are taken from a
    bounded sample; where they lie changes the pieces, never what is numbered by them."""
    share = min(1.0, 100 * parts / max(1, rows.count()))
    seen = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).sample(share, seed=1).limit(200 * parts).collect())
    points = sorted({seen[k * len(seen) // parts] for k in range(1, parts)}) if seen else []
    above = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= F.col(order))) if points else F.lit(0)
    return F.when(F.col(order).isNotNull(), above).otherwise(F.lit(-1))


def ranked_within(rows: DataFrame, group: str, order: list[str], part: Column, name: str) -> DataFrame:
    """``rows`` with consecutive numbers from 1 within each value of ``group``, in the order of columns.

    ``part`` cuts groups into pieces and must grow with the order (as its first column does, or a prefix of it). Each piece is numbered on
    its own, then shifted by the sizes of those before it, so a group is no single task's work. Rows of equal order are numbered in any order.
    """
    cut = rows.withColumn("__part", part)
    at = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    before = Window.partitionBy("__group").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (cut.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
              .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    return (cut.withColumn("__at", at).join(shifts, F.col(group).eqNullSafe(F.col("__group")) & F.col("__part").eqNullSafe(F.col("__p")))
            .select(*rows.columns, (F.col("__at") + F.col("__before")).alias(name)))


def coverage(jobs: DataFrame, valid_keys: DataFrame) -> DataFrame:
    """(circuit, n_jobs, n_valid, complete): complete if every job of the circuit is valid. Circuits without a job are absent."""
    marked = jobs.join(valid_keys.select("key", F.lit(True).alias("__valid")), "key", "left")
    valid = F.coalesce("__valid", F.lit(False))
    return marked.groupBy("circuit").agg(F.count("*").alias("n_jobs"), F.count_if(valid).alias("n_valid"), F.bool_and(valid).alias("complete"))


def missing_by_device(jobs: DataFrame, valid_keys: DataFrame) -> DataFrame:
    marked = jobs.join(valid_keys.select("key", F.lit(True).alias("__valid")), "key", "left")
    return marked.groupBy("device").agg(F.count("*").alias("n_jobs"), F.count_if(F.col("__valid").isNull()).alias("n_missing"))


def mean_duration(manifest: DataFrame) -> DataFrame:
    return manifest.where("duration_seconds is not null").agg(F.avg("duration_seconds").alias("mean_seconds"), F.count("*").alias("n"))


def last_errors(attempts: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, attempts, errors): the last attempt's errors of requests that no attempt satisfied."""
    last = attempts.groupBy(key).agg(F.max("attempt").alias("attempts"), F.max_by("errors", "attempt").alias("errors"), F.bool_or(F.size("errors") == 0).alias("ok"))
    return last.where("not ok").drop("ok")
