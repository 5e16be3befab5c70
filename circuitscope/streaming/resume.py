"""The append-only log as a stream: latest status, attempts, watchdogs; a restart resumes from the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as S

#: Seconds that a phase may take, and what the watchdog adds.
PHASE_SECONDS, STARTUP_SECONDS, GRACE_SECONDS = 300, 240, 30
#: What a job is at: nothing that is waited for, handed out, or in a started phase.
IDLE, WAITING, STARTED = 0, 1, 2


def read_log(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New lines of a log folder as a stream of typed rows, with when each was logged and ``place``, which orders them: by the
    records' own time, then by the file's age and name, then by attempt. Rows without a time come first."""
    v = F.col("v")
    at = F.col("_metadata")
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(
        F.try_parse_json("value").alias("v"), at["file_modification_time"].alias("modified"), at["file_path"].alias("file"))
    logged = F.try_to_timestamp(S.text_field(v, "$.timestamp"))
    attempt = S.int_field(v, "$.attempt", bool_as_int=True)
    return lines.where(S.is_object(v) & (S.kind(S.field(v, "$.key")) == "STRING")).select(
        S.text_field(v, "$.key").alias("key"), S.text_field(v, "$.device").alias("device"), S.text_field(v, "$.status").alias("status"),
        S.text_field(v, "$.phase").alias("phase"), attempt.alias("attempt"), logged.alias("logged"),
        F.struct(logged.alias("logged"), F.col("modified"), F.col("file"), attempt.alias("attempt")).alias("place"))


def latest_status(log: DataFrame) -> DataFrame:
    """(key, status, attempts), kept up to date: last status but ``running``, by place in the log, and the greatest attempt.

    Native aggregation: state is one row for each key, partial sums are made in each task, and a restart continues from the checkpoint.
    """
    done = F.when(F.coalesce("status", F.lit("")) != "running", F.col("place"))
    return log.groupBy("key").agg(F.max_by("status", done).alias("status"), F.coalesce(F.max("attempt"), F.lit(0)).alias("attempts"))


def hourly_outcomes(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """(window, status, n) by event time, closed once the watermark has passed."""
    return log.where("logged is not null").withWatermark("logged", late).groupBy(F.window("logged", "1 hour"), "status").agg(F.count("*").alias("n"))


def watch_phases(log: DataFrame, phase_seconds: int = PHASE_SECONDS, grace_seconds: int = GRACE_SECONDS,
                 startup_seconds: int = STARTUP_SECONDS) -> DataFrame:
    """(key, event, attempt): ``finished`` when a job reports an end, ``watchdog_timeout`` when a started phase is silent beyond its
    time and the grace, ``startup_timeout`` when a job that was handed out reports no start within ``startup_seconds`` and the grace.
    Needs ``logged`` as event time.

    Attempts count starts over a job's whole life, also behind an end or a timeout. State is three numbers for each job.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        attempts, since, phase = state.get if state.exists else (0, 0, IDLE)
        if state.hasTimedOut:
            out.append((key[0], "watchdog_timeout" if phase == STARTED else "startup_timeout", attempts))
            phase = IDLE
        else:
            rows = pd.concat(list(batches)).sort_values(["logged", "attempt"], kind="stable")
            for row in rows.itertuples():
                since = max(since, int(row.logged.timestamp() * 1000))
                if row.status == "running":
                    attempts += row.phase == "started"
                    phase = STARTED if row.phase == "started" or phase == STARTED else WAITING
                elif phase != IDLE:
                    out.append((key[0], "finished", attempts))
                    phase = IDLE
        state.update((attempts, since, phase))
        if phase != IDLE:
            wait = (phase_seconds if phase == STARTED else startup_seconds) + grace_seconds
            state.setTimeoutTimestamp(max(since + wait * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "event", "attempt"])

    return (log.where("logged is not null").withWatermark("logged", "0 seconds").select("key", "status", "phase", "attempt", "logged").groupBy("key")
            .applyInPandasWithState(step, "key string, event string, attempt int", "attempts int, since long, phase int", "append", GroupStateTimeout.EventTimeTimeout))


def store_recommendations(rows: DataFrame, table_path: str, checkpoint: str):
    """Starts a query that appends recommendations, each batch once; readers take the last version by request."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("version", F.lit(epoch)).write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
