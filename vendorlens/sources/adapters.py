"""The given tables seen as inputs of the vendor-risk operators, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlens.functions.lexicon import default_rows, values_sql
from vendorlens.functions.scalars import risk_level

#: Whole documents with a known selection of keywords put after the text (their prose has hardly any).
_KEYWORDS = [r[3] for r in default_rows()]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, text): ``doc_id % 5`` keywords are put after each text."""
    words = F.array(*[F.lit(k) for k in _KEYWORDS])
    n = F.pmod("doc_id", F.lit(5)).cast("int")
    term = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: F.element_at(words, ((F.col("doc_id") * 7 + (j - 1) * 37) % len(_KEYWORDS) + 1).cast("int")))
    joined = F.when(n > 0, F.concat(F.lit(" "), F.array_join(term, " "))).otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat(F.coalesce("text", F.lit("")), joined).alias("text"))


TEXT_SQL = f"""{values_sql()},
    f1 AS (
        SELECT doc_id, source, lang, coalesce(text, '') || CASE WHEN doc_id % 5 > 0 THEN ' ' || array_to_string(
            list_transform(range(0, doc_id % 5), lambda j: {_KEYWORDS!r}[((doc_id * 7 + j * 37) % {len(_KEYWORDS)} + 1)::INT]), ' ') ELSE '' END AS text FROM documents
    )"""

SIGNALS_SQL = f"""{TEXT_SQL},
    sig AS MATERIALIZED (
        SELECT f1.doc_id, f1.source, l.* FROM f1 JOIN lexicon l ON contains(lower(f1.text), l.keyword)
    ), vsig AS (SELECT DISTINCT source, ord, category, severity, keyword, weight, indicator FROM sig)"""


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vendor_id, name) of the sources of the documents."""
    return read(spark, sf_dir, "documents").where("source is not null").select(F.regexp_extract("source", "([0-9]+)$", 1).cast("long").alias("vendor_id"), F.col("source").alias("name")).distinct()


VENDORS_SQL = "vendors AS (SELECT DISTINCT regexp_extract(source, '([0-9]+)$', 1)::BIGINT AS vendor_id, source AS name FROM documents WHERE source IS NOT NULL)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-pass evidence: one hit for each document; even ones name the vendor in the title."""
    d = evidence_text(spark, sf_dir)
    title = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(": "), F.substring("text", 1, 60))).otherwise(F.substring("text", 1, 60))
    return d.select(
        "doc_id", F.regexp_extract("source", "([0-9]+)$", 1).cast("long").alias("vendor_id"), F.col("source").alias("vendor_name"), F.lit(1).alias("pass"),
        (F.col("doc_id") % 4).cast("int").alias("query_id"), F.col("doc_id").cast("int").alias("rank"), title.alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("snippet"), F.lit("search").alias("source"),
    )


def supplementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-pass evidence: known urls, null urls and new ones."""
    rows = evidence(spark, sf_dir).where("doc_id % 3 = 0")
    url = F.when(F.col("doc_id") % 6 == 0, F.col("url")).when(F.col("doc_id") % 9 == 3, F.lit(None)).otherwise(F.concat(F.lit("https://extra.example.org/"), F.col("doc_id").cast("string")))
    return rows.withColumns({"pass": F.lit(2), "query_id": F.lit(4), "url": url})


EVIDENCE_SQL = f"""{TEXT_SQL},
    ev AS (
        SELECT doc_id, regexp_extract(source, '([0-9]+)$', 1)::BIGINT AS vendor_id, source AS vendor_name, 1 AS pass, doc_id % 4 AS query_id, doc_id AS rank,
               CASE WHEN doc_id % 2 = 0 THEN source || ': ' || substring(text, 1, 60) ELSE substring(text, 1, 60) END AS title,
               'https://' || source || '.example.com/' || doc_id AS url, text AS snippet FROM f1
    ), ev2 AS (
        SELECT * REPLACE (2 AS pass, 4 AS query_id, CASE WHEN doc_id % 6 = 0 THEN url WHEN doc_id % 9 = 3 THEN NULL ELSE 'https://extra.example.org/' || doc_id END AS url)
        FROM ev WHERE doc_id % 3 = 0
    )"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report for each order."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("vendor_name"))
    score = (F.col("o_orderkey") * 37 % 101).cast("int")
    return o.join(c, "o_custkey").select(
        F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("vendor_id"), "vendor_name", score.alias("risk_score"), risk_level(score).alias("risk_level"),
        F.round(score / 125, 4).alias("disruption_probability"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


REPORTS_SQL = """reports AS (
        SELECT o_orderkey AS report_id, o_custkey AS vendor_id, c_name AS vendor_name, (o_orderkey * 37 % 101)::INTEGER AS risk_score,
               CASE WHEN o_orderkey * 37 % 101 >= 70 THEN 'CRITICAL' WHEN o_orderkey * 37 % 101 >= 50 THEN 'HIGH' WHEN o_orderkey * 37 % 101 >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
               round((o_orderkey * 37 % 101) / 125, 4) AS disruption_probability, o_orderdate AS created_at
        FROM orders JOIN customer ON c_custkey = o_custkey
    )"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each row of events."""
    e = read(spark, sf_dir, "events")
    pick = lambda *pairs: F.create_map(*[F.lit(x) for p in pairs for x in p])[F.col("event_type")]
    stage = pick(("signup", "recon"), ("view", "scraping"), ("click", "agents"), ("purchase", "scoring"), ("error", "failed"))
    progress = pick(("signup", 10), ("view", 35), ("click", 65), ("purchase", 80))
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), stage.alias("stage"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("message"),
        progress.alias("progress"), F.when(failed, "failed").otherwise("running").alias("status"), F.when(failed, F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error"),
    )


JOBS_SQL = """je AS (
        SELECT user_id::VARCHAR AS job_id, ts, CASE event_type WHEN 'signup' THEN 'recon' WHEN 'view' THEN 'scraping' WHEN 'click' THEN 'agents' WHEN 'purchase' THEN 'scoring' WHEN 'error' THEN 'failed' END AS stage,
               event_type || ' ' || event_id AS message, CASE event_type WHEN 'signup' THEN 10 WHEN 'view' THEN 35 WHEN 'click' THEN 65 WHEN 'purchase' THEN 80 END AS progress,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status, CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error FROM events
    )"""


def dated_signals(spark: SparkSession, sf_dir: str, signals: DataFrame) -> DataFrame:
    """Signals with a time and a day made from the document's id."""
    ts = F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 3_600_000_000)
    return signals.withColumn("ts", ts).withColumn("day", F.to_date("ts"))


DATED_SQL = "dsig AS (SELECT *, TIMESTAMP '2024-01-01' + to_hours(doc_id::INTEGER) AS ts, (TIMESTAMP '2024-01-01' + to_hours(doc_id::INTEGER))::DATE AS day FROM sig)"
