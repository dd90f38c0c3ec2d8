"""Schemas of the vendor-risk tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

VENDORS = "vendor_id BIGINT, name STRING NOT NULL, industry STRING, country STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
EVIDENCE = "vendor_id BIGINT, pass INT, query_id INT, rank INT, title STRING, url STRING, snippet STRING, source STRING"
EVIDENCE_CACHE = "vendor_name STRING, source_type STRING, content STRING, url STRING, language STRING, fetched_at TIMESTAMP"
ALERTS = "vendor_id BIGINT, vendor_name STRING, risk_level STRING, message STRING, triggered_signals ARRAY<STRING>, acknowledged BOOLEAN, created_at TIMESTAMP"
SIGNAL_GROUP = "STRUCT<category: STRING, severity: STRING, indicators: ARRAY<STRING>, weight: BIGINT>"
SOURCE = "STRUCT<url: STRING, title: STRING>"
RISK_REPORTS = (
    "report_id BIGINT, vendor_id BIGINT, vendor_name STRING, risk_score INT, risk_level STRING, confidence_score DOUBLE, "
    "disruption_probability DOUBLE, executive_summary STRING, risk_headline STRING, primary_risk_category STRING, "
    "key_findings ARRAY<STRING>, risk_trajectory STRING, recommended_actions ARRAY<STRING>, monitoring_signals ARRAY<STRING>, "
    f"time_horizon STRING, signals ARRAY<{SIGNAL_GROUP}>, sources ARRAY<{SOURCE}>, raw_intelligence STRING, status STRING, created_at TIMESTAMP"
)
JOB_EVENTS = "job_id STRING, ts TIMESTAMP, stage STRING, message STRING, progress INT, status STRING, error STRING"

#: Table name -> (schema, partition columns).
TABLES = {
    "vendors": (VENDORS, ()),
    "risk_reports": (RISK_REPORTS + ", report_date DATE", ("report_date",)),
    "evidence_cache": (EVIDENCE_CACHE, ("source_type", "language")),
    "alerts": (ALERTS + ", run STRING, batch BIGINT", ("run", "batch")),
}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create the stored tables where they don't exist; calling it again changes nothing."""
    for name, (schema, parts) in TABLES.items():
        by = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet{by}")
