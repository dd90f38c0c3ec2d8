"""Requests, report assembly, storage and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vendorlens.functions.lexicon import title_case
from vendorlens.functions.scalars import strip

# Defaults of fields that a stored or parsed report lacks.
DEFAULT_CATEGORY, LEGACY_CATEGORY, DEFAULT_TRAJECTORY, DEFAULT_HORIZON = "Operational", "Cybersecurity", "Stable", "Near-term"
SHORT_NARRATIVE = 50
SIGNALS_JSON = "array<struct<category:string,severity:string,indicators:array<string>,weight:bigint>>"
SOURCES_JSON = "array<struct<url:string,title:string>>"


def clean_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): names stripped, blank ones rejected, language EN and a job id where missing."""
    cleaned = requests.withColumn("vendor_name", strip(F.coalesce("vendor_name", F.lit(""))))
    cleaned = cleaned.withColumn("language", F.coalesce("language", F.lit("EN"))).withColumn("job_id", F.coalesce("job_id", F.uuid()))
    return cleaned.where("vendor_name <> ''"), cleaned.where("vendor_name = ''")


def scoring_text(summary: Column, findings: Column, pooled: Column) -> Column:
    """The narrative, or the pooled text where the narrative is blank or too short to be scored."""
    told = F.concat(summary, F.lit(" "), F.array_join(F.coalesce(findings, F.array().cast("array<string>")), " "))
    return F.when((strip(F.coalesce(summary, F.lit(""))) == "") | (F.length(told) < SHORT_NARRATIVE), pooled).otherwise(told)


def parse_reports(raw: DataFrame, raw_col: str = "raw_output") -> DataFrame:
    """Adds ``parsed`` (VARIANT): the text as JSON; else, without code fences, from the first { to the last }; else {}."""
    bare = F.regexp_replace(F.col(raw_col), "```(?:json)?", "")
    cut = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return raw.withColumn("parsed", F.coalesce(F.try_parse_json(raw_col), F.try_parse_json(cut), F.parse_json(F.lit("{}"))))


def field(key: str, kind: str, default: Column) -> Column:
    """A key of ``parsed``: its value if the key is there (empty or null values stay), else the default."""
    there = F.expr(f"try_variant_get(parsed, '$.{key}', 'variant')").isNotNull()
    return F.when(there, F.expr(f"try_variant_get(parsed, '$.{key}', '{kind}')")).otherwise(default)


def percent(p: Column) -> Column:
    """Truncated, as the narrative shows it: 0.29 gives 28."""
    return (p * 100).cast("int")


def narrative() -> dict[str, Column]:
    """Default summary, headline, findings and actions from the counts, level and probability of a row."""
    say = F.format_string
    pct = percent(F.col("disruption_probability"))
    return {
        "executive_summary": say(
            "%s was assessed from public evidence. %d sources were gathered. %d risk indicators in %d categories were detected. The overall risk level is %s with a disruption probability of %d%%.",
            "vendor_name", "source_count", "n_signals", "n_categories", "risk_level", pct,
        ),
        "risk_headline": say("%s: %s risk from %d sources.", "vendor_name", "risk_level", "source_count"),
        "key_findings": F.array(
            say("%d sources were gathered", "source_count"),
            say("%d risk indicators in %d categories were detected", "n_signals", "n_categories"),
            say("Disruption probability is %d%% over 90 days", pct),
            F.concat(F.lit("Trajectory: "), field("risk_trajectory", "string", F.lit(DEFAULT_TRAJECTORY))),
            F.lit("Monitoring continues"),
        ),
        "recommended_actions": F.array(F.lit("Monitor the vendor more closely"), F.lit("Request current financial and operational documents"), F.lit("Assess alternative vendors")),
    }


def assemble_reports(scores: DataFrame, *, created_at: Column | None = None) -> DataFrame:
    """One report for each row of scores with vendor_id, vendor_name, the score columns, source_count, scraped_chars, parsed,
    signals and sources.

    ``raw_intelligence`` repeats the headline fields, so that a history can be rebuilt from it alone (rebuild_history); its findings
    and actions are those that were parsed, not the default ones.
    """
    told = narrative()
    empty = F.array().cast("array<string>")
    get = {k: field(k, "array<string>" if k in ("key_findings", "recommended_actions") else "string", d) for k, d in told.items()}
    return scores.select(
        "vendor_id", "vendor_name", "risk_score", "risk_level", "confidence_score", "disruption_probability",
        get["executive_summary"].alias("executive_summary"), get["risk_headline"].alias("risk_headline"),
        field("primary_risk_category", "string", F.lit(DEFAULT_CATEGORY)).alias("primary_risk_category"),
        get["key_findings"].alias("key_findings"), field("risk_trajectory", "string", F.lit(DEFAULT_TRAJECTORY)).alias("risk_trajectory"),
        get["recommended_actions"].alias("recommended_actions"), field("monitoring_signals", "array<string>", empty).alias("monitoring_signals"),
        field("time_horizon", "string", F.lit(DEFAULT_HORIZON)).alias("time_horizon"),
        F.coalesce("signals", F.array().cast(SIGNALS_JSON)).alias("signals"), F.coalesce("sources", F.array().cast(SOURCES_JSON)).alias("sources"),
        F.to_json(F.struct(
            F.col("source_count").alias("search_results_count"), F.col("scraped_chars").alias("scraped_content_chars"),
            field("primary_risk_category", "string", F.lit(DEFAULT_CATEGORY)).alias("primary_risk_category"), get["risk_headline"].alias("risk_headline"),
            field("risk_trajectory", "string", F.lit(DEFAULT_TRAJECTORY)).alias("risk_trajectory"), field("time_horizon", "string", F.lit(DEFAULT_HORIZON)).alias("time_horizon"),
            field("key_findings", "array<string>", empty).alias("key_findings"), field("recommended_actions", "array<string>", empty).alias("recommended_actions"),
        )).alias("raw_intelligence"),
        F.lit("completed").alias("status"), (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def with_defaults(reports: DataFrame) -> DataFrame:
    """Defaults of stored fields that are missing or null."""
    defaults = {
        "risk_score": F.lit(0), "risk_level": F.lit("LOW"), "confidence_score": F.lit(0.0), "disruption_probability": F.lit(0.0), "executive_summary": F.lit(""),
        "signals": F.array().cast(SIGNALS_JSON), "sources": F.array().cast(SOURCES_JSON), "raw_intelligence": F.lit("{}"), "status": F.lit("completed"),
    }
    return reports.withColumns({c: F.coalesce(F.col(c), d) if c in reports.columns else d for c, d in defaults.items()})


def upsert_vendors(vendors: DataFrame, incoming: DataFrame) -> DataFrame:
    """The vendors and those incoming names that are new, with ids after the largest; known rows stay as they are.

    Ids of new names are dense: counted per hash bucket first, so no task sees all names.
    """
    new = incoming.where("name is not null").select("name").distinct().join(vendors.select("name"), "name", "left_anti")
    new = new.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(64)))
    sizes = new.groupBy("bucket").count()
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.bucket") < F.col("a.bucket"), "left").groupBy(F.col("a.bucket").alias("bucket")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    top = vendors.agg(F.coalesce(F.max("vendor_id"), F.lit(0)).alias("top"))
    numbered = new.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("name"))).join(before, "bucket").crossJoin(F.broadcast(top))
    rows = numbered.select((F.col("top") + F.col("before") + F.col("n")).alias("vendor_id"), "name")
    return vendors.unionByName(rows, allowMissingColumns=True)


def append_reports(reports: DataFrame, path: str) -> None:
    """Append to a table partitioned by day."""
    with_defaults(reports).withColumn("report_date", F.to_date("created_at")).write.mode("append").partitionBy("report_date").parquet(path)


def delete_reports(reports: DataFrame, ids: DataFrame) -> DataFrame:
    """The reports without those ids."""
    return reports.join(ids.select("report_id").distinct(), "report_id", "left_anti")


def delete_stored(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Delete from a stored table, rewriting only the days that hold one of the ids; returns how many matched.

    Each day is replaced by Spark's commit as a whole. Days that lose all rows are removed after that; if the
    job ends in between, they still hold rows with the ids, and the same call again removes them.
    """
    stored = spark.read.parquet(path)
    hit = stored.join(ids.select("report_id").distinct(), "report_id", "left_semi").groupBy("report_date").count().collect()
    days = [r.report_date for r in hit]
    if not days:
        return 0
    touched = stored.where(F.col("report_date").isin(days))
    kept = delete_reports(touched, ids).checkpoint()
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        kept.write.mode("overwrite").partitionBy("report_date").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    left = {r.report_date for r in kept.select("report_date").distinct().collect()}
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for day in set(days) - left:  # days with no row left
        gone = jvm(f"{path}/report_date={day}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return sum(r["count"] for r in hit)


def by_id(reports: DataFrame, report_id: int) -> DataFrame:
    return reports.where(F.col("report_id") == report_id)


def recent(reports: DataFrame, n: int) -> DataFrame:
    """The newest n, ties by the larger id."""
    return reports.orderBy(F.desc("created_at"), F.desc("report_id")).limit(n)


def latest_per_vendor(reports: DataFrame) -> DataFrame:
    """The newest report of each vendor, as an aggregate (no window over a vendor's whole history)."""
    rest = [c for c in reports.columns if c != "vendor_id"]
    best = reports.groupBy("vendor_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "report_id")).alias("x"))
    return best.select("vendor_id", *[F.col("x")[c].alias(c) for c in rest]).select(*reports.columns)


def decode_legacy(legacy: DataFrame) -> DataFrame:
    """JSON text columns of imported rows as nested columns."""
    return legacy.withColumns({"signals": F.from_json("signals", SIGNALS_JSON), "sources": F.from_json("sources", SOURCES_JSON), "raw": F.try_parse_json("raw_intelligence")})


def rebuild_history(decoded: DataFrame) -> DataFrame:
    """Headline fields of imported rows from their raw part: its value if the key is there, else a default."""
    there = lambda k: F.expr(f"try_variant_get(raw, '$.{k}', 'variant')").isNotNull()
    value = lambda k, t: F.expr(f"try_variant_get(raw, '$.{k}', '{t}')")
    first = F.expr("get(signals, 0).category")
    empty = F.array().cast("array<string>")
    return decoded.withColumns({
        "generated_at": F.col("created_at"),
        "primary_risk_category": F.when(there("primary_risk_category"), value("primary_risk_category", "string")).otherwise(F.coalesce(title_case(first), F.lit(LEGACY_CATEGORY))),
        "risk_headline": F.when(there("risk_headline"), value("risk_headline", "string")).otherwise(F.concat("vendor_name", F.lit(" risk profile"))),
        "time_horizon": F.when(there("time_horizon"), value("time_horizon", "string")).otherwise(DEFAULT_HORIZON),
        "risk_trajectory": F.when(there("risk_trajectory"), value("risk_trajectory", "string")).otherwise(DEFAULT_TRAJECTORY),
        "key_findings": F.when(there("key_findings"), value("key_findings", "array<string>")).otherwise(empty),
        "recommended_actions": F.when(there("recommended_actions"), value("recommended_actions", "array<string>")).otherwise(empty),
    })
