"""Signals, scores and alerts of a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlens.functions.lexicon import default_rows
from vendorlens.functions.scalars import risk_level
from vendorlens.operators.scoring import NO_SIGNALS, confidence, disruption
from vendorlens.operators.signals import extract_signals, signal_array


def stream_signals(documents: DataFrame, keys: list[str], text_col: str = "text", rows: list | None = None) -> DataFrame:
    """The signals of each document, without state."""
    return documents.select(*keys, F.explode(signal_array(text_col, default_rows() if rows is None else rows)).alias("s")).select(*keys, "s.*")


def stream_scores(signals: DataFrame, key: str) -> DataFrame:
    """Scores of each key from all its signals so far (update mode). The state holds the distinct signals of a
    key, so at most as many as the lexicon has entries."""
    rows = signals.groupBy(key).agg(F.collect_set(F.struct("category", "severity", "keyword", "weight")).alias("s"))
    total = F.aggregate("s", F.lit(0), lambda a, x: a + x.weight)
    has = lambda f, v: F.exists("s", lambda x: x[f] == v)
    score = F.least(F.lit(100), total).cast("int")
    n, cats = F.size("s"), F.size(F.array_distinct(F.transform("s", lambda x: x.category)))
    empty = n == 0
    return rows.select(
        key,
        F.when(empty, NO_SIGNALS["risk_score"]).otherwise(score).alias("risk_score"),
        F.when(empty, NO_SIGNALS["risk_level"]).otherwise(risk_level(score)).alias("risk_level"),
        F.when(empty, NO_SIGNALS["confidence_score"]).otherwise(confidence(cats, n)).alias("confidence_score"),
        F.when(empty, NO_SIGNALS["disruption_probability"]).otherwise(disruption(score, has("severity", "critical"), has("category", "financial") & has("category", "operational"))).alias("disruption_probability"),
    )


def window_counts(signals: DataFrame, ts_col: str = "ts", *, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Signals and weight for each window and category; on a stream in append mode, later rows than ``late`` are dropped."""
    rows = signals.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    if signals.isStreaming:
        rows = rows.withWatermark(ts_col, late)
    out = rows.groupBy(F.window(ts_col, width, slide) if slide else F.window(ts_col, width), "category").agg(F.count("*").alias("n_signals"), F.sum("weight").alias("total_weight"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "category", "n_signals", "total_weight")


def activity_sessions(events: DataFrame, key: str, ts_col: str = "ts", *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of activity of each key, ended by a gap."""
    rows = events.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts_col, late)
    out = rows.groupBy(key, F.session_window(ts_col, gap)).agg(F.count("*").alias("n_events"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events")


def alert_stream(signals: DataFrame, key: str, ts_col: str = "ts", *, late: str = "1 day") -> DataFrame:
    """One alert for each key, category and severity within the watermark."""
    rows = signals.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    if signals.isStreaming:
        rows = rows.withWatermark(ts_col, late).dropDuplicatesWithinWatermark([key, "category", "severity"])
    else:
        rows = rows.groupBy(key, "category", "severity").agg(F.min(ts_col).alias(ts_col), F.min_by("indicator", F.struct(ts_col, "ord")).alias("indicator"))
    return rows.select(key, ts_col, F.concat(F.initcap("category"), F.lit(" risk detected")).alias("message"), F.upper("severity").alias("risk_level"), F.array("indicator").alias("triggered_signals"), F.lit(False).alias("acknowledged"))


def store_alerts(alerts: DataFrame, path: str, checkpoint: str, *, key: str, id_col: str | None = None, ts_col: str = "ts"):
    """Append a stream of alerts (alert_stream) to the stored table, a batch at a time; returns the query.

    A batch has a folder by the checkpoint's own id and its number: one that is run again after a failure replaces its own files, so no alert is
    stored twice, and a stream with another checkpoint touches nothing that is stored, acknowledgements included.
    """

    def append(batch: DataFrame, number: int) -> None:
        vendor = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
        rows = batch.select(vendor.alias("vendor_id"), F.col(key).cast("string").alias("vendor_name"), "risk_level", "message", "triggered_signals", "acknowledged", F.col(ts_col).alias("created_at"))
        run = batch.sparkSession.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return alerts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(append).trigger(availableNow=True).start()


def signals_with_table(documents: DataFrame, keys: list[str], load: Callable[[SparkSession], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, *, text_col: str = "text", distinct: bool = False, **trigger):
    """Signals of a stream of documents with a lexicon table that is read anew for each batch; returns the query.

    ``load`` gives the table, ``write`` takes the signals of a batch and its number (a batch that is run again has the same number).
    An entry added to the table counts from the next batch on; ``trigger`` as in writeStream (availableNow by default).
    """

    def each(batch: DataFrame, number: int) -> None:
        write(extract_signals(batch, keys, text_col, load(batch.sparkSession), distinct=distinct), number)

    return documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()
