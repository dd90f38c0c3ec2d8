"""Job progress: the fold of events to states, as a stream or a batch, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlens.operators.segments import neighbour, time_segment
from vendorlens.schemas import JOB_EVENTS

TERMINAL = ("completed", "failed")


def job_events(spark: SparkSession, path: str, *, files_per_trigger: int = 1) -> DataFrame:
    """A stream of job events from Parquet files as they arrive."""
    return spark.readStream.schema(JOB_EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def job_state(events: DataFrame) -> DataFrame:
    """Latest stage, message, progress and status of each job; the same for a stream (update mode) and a batch.

    A terminal status wins over progress that comes after it; a failure keeps the last stage and progress
    of the run and sets the error. State is one row for each job.
    """
    terminal = F.col("status").isin(*TERMINAL)
    last = F.struct("ts", "progress", "stage", "message")
    out = events.groupBy("job_id").agg(
        F.max(F.when(F.coalesce(~terminal, F.lit(True)), last)).alias("p"),
        F.max(F.when(terminal, F.struct("ts", "status", "error", "progress", "stage", "message"))).alias("t"),
    )
    done = F.col("t.status") == "completed"
    pick = lambda c: F.when(done, F.col("t")[c]).otherwise(F.coalesce(F.col("p")[c], F.col("t")[c]))
    return out.select("job_id", F.coalesce("t.status", F.lit("running")).alias("status"), pick("stage").alias("stage"), pick("message").alias("message"), F.coalesce(pick("progress"), F.lit(0)).alias("progress"), F.col("t.error").alias("error"))


def stage_durations(events: DataFrame, *, days: float = 1) -> DataFrame:
    """(job_id, ts, stage, micros) until the job's next event; a job's events are cut into segments of so many days."""
    rows = events.select("job_id", "ts", "stage", "progress")
    found = neighbour(rows, ["job_id"], ["ts", "progress", "stage"], {"_next": "ts"}, time_segment(F.col("ts"), days), ahead=True)
    return found.select("job_id", "ts", "stage", (F.unix_micros("_next") - F.unix_micros("ts")).alias("micros"))


def job_funnel(states: DataFrame, durations: DataFrame) -> DataFrame:
    """(stage, status, jobs, mean_seconds): jobs by last stage and status, and the mean time of the stage."""
    mean = durations.groupBy("stage").agg(F.round(F.avg("micros") / 1e6, 3).alias("mean_seconds"))
    return states.groupBy("stage", "status").agg(F.count("*").alias("jobs")).join(mean, "stage", "left")
