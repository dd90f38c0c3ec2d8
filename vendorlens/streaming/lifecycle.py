"""Jobs with an end: finished ones leave the state of a stream, silent ones fail after a timeout."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vendorlens.streaming.jobs import TERMINAL, job_state

OUTCOME = "job_id string, status string, stage string, message string, progress int, error string"
_STATE = "ended boolean, micros long, stage string, message string, progress int"
_Outcome = Row("job_id", "status", "stage", "message", "progress", "error")
#: Error of a job that fell silent.
SILENT = "no progress before the timeout"


def _rank(*values) -> tuple:
    """Comparable as a struct is: null first."""
    return tuple((v is not None, v) for v in values)


class JobLifecycle(StatefulProcessor):
    """The last progress of each running job, and for ``linger_ms`` after its end a mark that it has ended."""

    def __init__(self, timeout_ms: int, linger_ms: int):
        self.timeout_ms, self.linger_ms = timeout_ms, linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _STATE)

    def _wake(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.state.get() if self.state.exists() else None
        if last is not None and last[0]:
            return  # what comes after the end changes nothing
        best = None if last is None else _rank(*(last[i] for i in (1, 4, 2, 3)))
        end, newest = None, None
        for r in rows:
            newest = r._micros if newest is None else max(newest, r._micros)
            if r.status in TERMINAL:
                end = max(end or (), _rank(r._micros, r.status, r.error, r.progress, r.stage, r.message))
            else:
                best = max(best or (), _rank(r._micros, r.progress, r.stage, r.message))
        micros, progress, stage, message = (None if not best else v for _, v in (best or _rank(*[None] * 4)))
        if end is not None:
            _, status, error, p, s, m = (v for _, v in end)
            if status == "completed" or best is None:
                progress, stage, message = p, s, m
            self.state.update((True, end[0][1], None, None, None))
            self._wake(newest // 1000 + self.linger_ms)
            yield _Outcome(key[0], status, stage, message, progress or 0, error)
        else:
            self.state.update((False, micros, stage, message, progress))
            self._wake(micros // 1000 + self.timeout_ms)
            yield _Outcome(key[0], "running", stage, message, progress or 0, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.state.get() if self.state.exists() else None
        self.state.clear()
        if last is not None and not last[0]:
            yield _Outcome(key[0], "failed", last[2], last[3], last[4] or 0, SILENT)


def job_lifecycle(events: DataFrame, *, timeout_seconds: int = 600, linger_seconds: int = 600, late: str = "1 minute") -> DataFrame:
    """The states of jobs as they change (update mode), like job_state's, of a stream of job events.

    An ended job leaves the state ``linger_seconds`` after its last event (until then, late progress is ignored); a job without
    events for ``timeout_seconds`` fails. Both are told by the watermark, ``late`` behind the newest event. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass). Events without a time are left out, as no timer could end their job.
    """
    rows = events.where("ts is not null").withColumn("_micros", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithState(JobLifecycle(1000 * timeout_seconds, 1000 * linger_seconds), outputStructType=OUTCOME, outputMode="Update", timeMode="EventTime")


def job_outcome(events: DataFrame, *, timeout_seconds: int = 600) -> DataFrame:
    """The batch twin: job_state, with running jobs failed that were silent for the timeout before the newest of all events."""
    timed = events.where("ts is not null")
    seen = timed.groupBy("job_id").agg(F.max(F.when(F.coalesce(~F.col("status").isin(*TERMINAL), F.lit(True)), F.col("ts"))).alias("_last"))
    newest = timed.agg(F.max("ts").alias("_newest"))  # one row
    silent = (F.col("status") == "running") & (F.unix_micros("_newest") - F.unix_micros("_last") >= timeout_seconds * 1_000_000)
    rows = job_state(timed).join(seen, "job_id").join(F.broadcast(newest))
    return rows.select("job_id", F.when(silent, "failed").otherwise(F.col("status")).alias("status"), "stage", "message", "progress", F.when(silent, SILENT).otherwise(F.col("error")).alias("error"))
