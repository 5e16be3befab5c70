"""Devices as a keyed state machine over the log: workers that get ready, jobs that start and end, and timers that see them go silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .resume import GRACE_SECONDS, PHASE_SECONDS, STARTUP_SECONDS

#: What a row of the log says about a device. Any other status ends the job.
QUEUED, READY, RUNNING, DONE = "queued", "ready", "running", "done"
#: What a device is at.
STARTING, WORKING, CLOSED = "starting", "working", "closed"
OUTPUT = "device string, key string, event string, attempt int"


class DeviceWatch(StatefulProcessor):
    """One device: its phase and the attempt at which it is closed, and its open jobs as a map from key to attempts and deadline.

    The map is state of its own: a row reads and writes the entry of its job only, and a device may have any number of jobs.
    Deadlines are processing time, so a log that goes silent fires them all the same. There is one timer for each deadline in use.
    """

    def __init__(self, phase_seconds: float, startup_seconds: float, grace_seconds: float, max_attempts: int):
        self.phase_ms, self.startup_ms = (int(1000 * (s + grace_seconds)) for s in (phase_seconds, startup_seconds))
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.device = handle.getValueState("device", "phase string, deadline long")
        self.jobs = handle.getMapState("jobs", "key string", "attempts int, deadline long")

    def _timer(self, deadline: int) -> None:
        self.handle.registerTimer(deadline)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        phase, deadline = self.device.get() if self.device.exists() else (None, 0)
        before, out = (phase, deadline), []
        for row in pd.concat(list(rows)).sort_values(["logged", "attempt"], kind="stable", na_position="first").itertuples():
            job = row.key if isinstance(row.key, str) else None
            known = job is not None and self.jobs.containsKey((job,))
            attempts = int(self.jobs.getValue((job,))[0]) if known else 0
            attempt = max(attempts, int(row.attempt) if row.attempt == row.attempt and row.attempt is not None else 0)
            if row.status == READY:
                if phase != WORKING:
                    out.append((key[0], None, "ready", 0))
                phase, deadline = WORKING, 0
            elif row.status == DONE:
                if phase is not None and phase != CLOSED:
                    out.append((key[0], None, "done", 0))
                phase, deadline = CLOSED, 0
            elif job is not None and row.status == QUEUED:
                if phase in (None, CLOSED):
                    phase, deadline = STARTING, now + self.startup_ms
                    self._timer(deadline)
                if not known:
                    self.jobs.updateValue((job,), (attempt, 0))
            elif job is not None and row.status == RUNNING:
                limit = now + self.phase_ms
                self.jobs.updateValue((job,), (max(attempt, attempts + 1) if row.phase == "started" else attempt, limit))
                self._timer(limit)
                phase, deadline = WORKING, 0  # a job that runs has a worker
            elif job is not None and known:
                out.append((key[0], job, "finished", attempt))
                self.jobs.removeKey((job,))
        if (phase, deadline) != before and phase is not None:
            self.device.update((phase, deadline))
        if out:
            yield pd.DataFrame(out, columns=["device", "key", "event", "attempt"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        phase, deadline = self.device.get() if self.device.exists() else (None, 0)
        late = []
        if phase == STARTING and deadline and deadline <= fired:
            # the worker never came: everything that waits for the device has failed for good
            late = [(k[0], "startup_timeout", max(int(v[0]), self.max_attempts)) for k, v in self.jobs.iterator()]
            self.device.update((CLOSED, 0))
        else:
            late = [(k[0], "watchdog_timeout", int(v[0])) for k, v in self.jobs.iterator() if v[1] and v[1] <= fired]
        for job, _, _ in late:
            self.jobs.removeKey((job,))
        if late:
            yield pd.DataFrame([(key[0], *x) for x in late], columns=["device", "key", "event", "attempt"])

    def close(self) -> None:
        pass


def watch_devices(log: DataFrame, phase_seconds: float = PHASE_SECONDS, startup_seconds: float = STARTUP_SECONDS, grace_seconds: float = GRACE_SECONDS,
                  max_attempts: int = 3) -> DataFrame:
    """(device, key, event, attempt) of a log stream as :func:`.resume.read_log` gives it.

    Events: ``ready`` and ``done`` of a device, ``finished`` of an open job, ``watchdog_timeout`` of a job of which nothing was heard for ``phase_seconds``
    and the grace, ``startup_timeout`` of every open job of a device that was given jobs and reported neither ready nor a running job in ``startup_seconds`` and the
    grace; such jobs are out of attempts. Rows without a device are left out. Time is the cluster's clock, so timers also fire when no row comes, and
    after a restart from the checkpoint. An end that is reported twice, or after a timeout, gives one event. Needs the RocksDB state store:
    ``spark.sql.streaming.stateStore.providerClass``.
    """
    rows = log.where("device IS NOT NULL").select("device", "key", "status", "phase", F.col("attempt").cast("int").alias("attempt"), "logged")
    watch = DeviceWatch(phase_seconds, startup_seconds, grace_seconds, max_attempts)
    return rows.groupBy("device").transformWithStateInPandas(watch, OUTPUT, "append", "processingTime")
