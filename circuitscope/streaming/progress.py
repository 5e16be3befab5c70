"""What the log changes, kept up batch by batch: coverage and pending work of circuits, and results matched to the jobs that started."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import scalars as S
from ..operators import jobs as J
from ..sources import readers

COVERAGE = "circuit string, n_jobs long, n_valid long, n_pending long, complete boolean"


def read_records(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New lines of a log folder as a stream of the rows that :func:`.readers.parse_manifest` gives; ``line_no`` orders them by
    the records' own time, then by the file's age and name, then by attempt."""
    at, v = F.col("_metadata"), F.try_parse_json("value")
    place = F.struct(F.try_to_timestamp(S.text_field(v, "$.timestamp")).alias("logged"), at["file_modification_time"].alias("modified"), at["file_path"].alias("file"),
                     S.int_field(v, "$.attempt", bool_as_int=True).alias("attempt"))
    return readers.parse_manifest(spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(place.alias("line_no"), "value"))


class CircuitProgress(StatefulProcessor):
    """One circuit: its jobs as a map from key to the last record that counts, and the counts that were given out last."""

    def __init__(self, max_attempts: int):
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "key string", "logged long, modified long, file string, attempt int, valid boolean, attempts int")
        self.told = handle.getValueState("told", "n_jobs long, n_valid long, n_pending long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        keys = set(initialState["key"])
        for job in keys:
            self.jobs.updateValue((job,), (-2, -2, "", -2, False, 0))
        self.told.update((len(keys), 0, len(keys)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.told.exists():
            return  # no job of ours
        n_jobs, n_valid, n_pending = before = tuple(int(x) for x in self.told.get())
        for job, of_job in pd.concat(list(rows)).groupby("key"):
            if not self.jobs.containsKey((job,)):
                continue
            *place, valid, attempts = self.jobs.getValue((job,))
            was_valid, was_pending = valid, not valid and attempts < self.max_attempts
            attempts = max(int(attempts), int(of_job["attempt"].max()))
            ended = of_job[of_job["ended"]]
            for r in ended.itertuples():
                here = [int(r.logged), int(r.modified), r.file, int(r.attempt)]
                if here >= [int(place[0]), int(place[1]), place[2], int(place[3])]:
                    place, valid = here, bool(r.valid)
            n_valid += int(valid) - int(was_valid)
            n_pending += int(not valid and attempts < self.max_attempts) - int(was_pending)
            self.jobs.updateValue((job,), (*place, bool(valid), attempts))
        if (n_jobs, n_valid, n_pending) != before:
            self.told.update((n_jobs, n_valid, n_pending))
            yield pd.DataFrame([(key[0], n_jobs, n_valid, n_pending, n_valid == n_jobs)], columns=["circuit", "n_jobs", "n_valid", "n_pending", "complete"])

    def close(self) -> None:
        pass


def circuit_progress(records: DataFrame, jobs: DataFrame, max_attempts: int = 3) -> DataFrame:
    """(circuit, n_jobs, n_valid, n_pending, complete) of circuits whose counts a batch of the log changes.

    ``records``: a stream of :func:`read_records`; ``jobs``: circuit and key of every job, the initial state. A job is valid if its last record that isn't
    ``running`` is a strict success, and pending if it is not and has attempts left: so what was given out last for each circuit equals
    the batch operators over the log so far, with circuits that no record changed at no valid job. State is one entry for each job, kept by
    circuit; a record costs one lookup. Needs the RocksDB state store.
    """
    number = lambda c: F.coalesce(F.unix_micros(c), F.lit(-1))
    rows = records.where("circuit IS NOT NULL").select(
        "circuit", "key", number(F.col("line_no.logged")).alias("logged"), number(F.col("line_no.modified")).alias("modified"), F.col("line_no.file").alias("file"),
        F.coalesce(F.col("attempt").cast("int"), F.lit(0)).alias("attempt"), (F.coalesce("status", F.lit("")) != "running").alias("ended"), J.strict_success().alias("valid"))
    start = jobs.select("circuit", "key").distinct().groupBy("circuit")
    return rows.groupBy("circuit").transformWithStateInPandas(CircuitProgress(max_attempts), COVERAGE, "update", "none", initialState=start)


def matched_results(starts: DataFrame, results: DataFrame, longest: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Each result with the job whose worker reports it: (device, pid, key, status, started, finished); key and started are null if it answers none.

    ``starts``: device, pid, key, started; ``results``: message, device, pid, status, finished: both streams, by event time, rows up to ``late`` late. A result belongs to the
    start of its device and pid in the ``longest`` before it, so a pid that is used again later meets its own job. A message that comes twice within
    ``longest`` counts once. A result that answers nothing is given out with nulls once the watermark shows that no start can come any more; that is
    also how one that comes before its start by event time ends. State is dropped behind the watermark on both sides.
    """
    begun = starts.withWatermark("started", late).alias("s")
    once = results.withWatermark("finished", longest).dropDuplicatesWithinWatermark(["message"]).alias("r")
    own = ((F.col("r.device") == F.col("s.device")) & (F.col("r.pid") == F.col("s.pid"))
           & (F.col("r.finished") >= F.col("s.started")) & (F.col("r.finished") <= F.col("s.started") + F.expr(f"INTERVAL {longest}")))
    return once.join(begun, own, "left_outer").select("r.device", "r.pid", "s.key", "r.status", "s.started", "r.finished")
