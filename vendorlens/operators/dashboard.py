"""Aggregates and derived rows for dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendorlens.functions.scalars import LEVELS
from vendorlens.operators.reports import recent

# How many reports and alerts are shown, and the limits of the usage classes.
SCOPE, TOP_CRITICAL, LEAST_ALERTS, MOST_ALERTS = 100, 3, 4, 10
CALL_LIMIT, CALL_FLAG_PERCENT, COST_OPTIMAL, COST_NORMAL = 10, 80, 1.0, 2.5
FILLERS = (("Regional news signal", "Live scan complete", "MEDIUM"), ("Operational monitor active", "Monitor watching", "LOW"))

# What a report card and the list of reports show.
SHOWN_INDICATORS, SHOWN_SOURCES, SHOWN_REPORTS = 3, 6, 5

# Texts of the labels by language.
LABELS = {
    "EN": ("Short-term", "Medium-term", "Long-term", "Improving", "Deteriorating", "Stable"),
    "ZH": ("短期", "中期", "长期", "正在改善", "持续恶化", "保持稳定"),
    "AR": ("قصير المدى", "متوسط المدى", "طويل المدى", "في تحسن", "يتدهور", "مستقر"),
    "BN": ("স্বল্পমেয়াদী", "মধ্যম মেয়াদী", "দীর্ঘমেয়াদী", "উন্নতি ঘটছে", "অবনতি ঘটছে", "স্থিতিশীল"),
    "DE": ("Kurzfristig", "Mittelfristig", "Langfristig", "Verbessernd", "Verschlechternd", "Stabil"),
    "JA": ("短期", "中期", "長期", "改善中", "悪化中", "安定"),
}
LABEL_KEYS = ("shortTerm", "midTerm", "longTerm", "improving", "deteriorating", "stable")


def label_dict(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lang, k, t) for lang, texts in LABELS.items() for k, t in zip(LABEL_KEYS, texts, strict=True)], "lang string, key string, text string")


def stats(reports: DataFrame, n: int | None = SCOPE) -> DataFrame:
    """One row over the newest n reports (all, if None): total, reports by level, mean score and newest critical ones."""
    seen = reports if n is None else recent(reports, n)
    by_level = seen.groupBy("risk_level").agg(F.count("*").alias("n"), F.sum("risk_score").alias("s"))
    levels = seen.sparkSession.createDataFrame([(name,) for name, _ in LEVELS], "risk_level string")
    zero = levels.join(by_level, "risk_level", "full").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0)).alias("s"))
    total = zero.agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_level", "n")))).alias("distribution"), F.sum("s").alias("s"))
    critical = recent(seen.where("risk_level = 'CRITICAL'"), TOP_CRITICAL).agg(F.collect_list(F.struct("created_at", "report_id", "vendor_name", "risk_score")).alias("x"))
    newest = F.slice(F.reverse(F.array_sort("x")), 1, TOP_CRITICAL)
    return total.crossJoin(critical).select("total", "distribution", newest.alias("recent_critical"), F.when(F.col("total") > 0, F.col("s") / F.col("total")).otherwise(0.0).alias("average"))


def alerts(reports: DataFrame) -> DataFrame:
    """(report_id, position, message, detail, level, fresh): one for each signal group, two general ones where there are
    few, at most ten. Built as an array in the row, so no report is gathered from others."""
    item = lambda m, d, v, f: F.struct(m.alias("message"), d.alias("detail"), v.alias("level"), f.alias("fresh"))
    level = lambda s: F.coalesce(F.nullif(F.upper(s.severity), F.lit("")), F.lit("LOW"))
    own = F.transform(
        F.coalesce("signals", F.array().cast("array<struct<category:string,severity:string,indicators:array<string>,weight:bigint>>")),
        lambda s: item(F.concat(s.category, F.lit(" risk detected")), F.coalesce(F.nullif(F.get(s.indicators, F.lit(0)), F.lit("")), s.category), level(s), level(s).isin("CRITICAL", "HIGH")),
    )
    fill = F.array(*[item(F.lit(m), F.lit(d), F.lit(v), F.lit(False)) for m, d, v in FILLERS])
    rows = reports.withColumn("_own", own).withColumn("_all", F.slice(F.when(F.size("_own") < LEAST_ALERTS, F.concat("_own", fill)).otherwise(F.col("_own")), 1, MOST_ALERTS))
    return rows.select("report_id", F.posexplode("_all").alias("position", "a")).select("report_id", "position", "a.*")


def cards(reports: DataFrame) -> DataFrame:
    """The reports with as much as a card shows: the first indicators of each signal group and the first sources."""
    shown = F.transform("signals", lambda s: s.withField("indicators", F.slice(s.indicators, 1, SHOWN_INDICATORS)))
    return reports.withColumns({"signals": shown, "sources": F.slice("sources", 1, SHOWN_SOURCES)})


def front_page(reports: DataFrame, n: int = SHOWN_REPORTS) -> DataFrame:
    """The cards of the newest reports."""
    return cards(recent(reports, n))


def governance(usage: DataFrame) -> DataFrame:
    """Percent of the call limit, flag above 80, and cost class of each usage row."""
    share = F.least(F.lit(100.0), F.col("search_calls") / CALL_LIMIT * 100)
    cost = F.when(F.col("model_cost") < COST_OPTIMAL, "OPTIMAL").when(F.col("model_cost") < COST_NORMAL, "NORMAL").otherwise("ELEVATED")
    return usage.withColumn("query_percent", share).withColumn("flagged", share > CALL_FLAG_PERCENT).withColumn("cost_class", cost)


def report_counts(reports: DataFrame) -> DataFrame:
    """Sources and signals of each report, 0 where there are none."""
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return reports.select("report_id", n("sources").alias("n_sources"), n("signals").alias("n_signals"))


def tiles(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count("*").alias("total"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"), F.count_if(F.col("risk_level") == "HIGH").alias("high"), F.floor(F.coalesce(F.avg("risk_score"), F.lit(0.0)) + 0.5).alias("average"))


def _key(c: str, *pairs: tuple[str, str]) -> Column:
    out = None
    for part, key in pairs:
        out = F.when(F.lower(c).contains(part), key) if out is None else out.when(F.lower(c).contains(part), key)
    return out


def localise(reports: DataFrame, labels: DataFrame, language_col: str = "language") -> DataFrame:
    """Horizon and trajectory in the report's language; EN and unknown languages stay, as do values without a label.

    The labels are a small dimension; Spark broadcasts them by their size."""
    known = labels.select("lang").distinct().withColumn("known", F.lit(True))
    rows = reports.join(known, F.col(language_col) == F.col("lang"), "left").drop("lang")
    lang = F.when(F.col("known"), F.col(language_col)).otherwise("EN")
    keyed = rows.withColumns({"_lang": lang, "_h": _key("time_horizon", ("short", "shortTerm"), ("medium", "midTerm"), ("mid", "midTerm"), ("long", "longTerm")), "_t": _key("risk_trajectory", ("improv", "improving"), ("deteriorat", "deteriorating"), ("stabl", "stable"))})
    named = lambda alias, key: labels.select(F.col("lang").alias("_lang"), F.col("key").alias(key), F.col("text").alias(alias))
    both = keyed.join(named("_ht", "_h"), ["_lang", "_h"], "left").join(named("_tt", "_t"), ["_lang", "_t"], "left")
    plain = F.col("_lang") == "EN"
    show = lambda label, c: F.coalesce(F.when(~plain, F.col(label)), F.nullif(F.col(c), F.lit("")), F.lit("—"))
    return both.withColumns({"time_horizon": show("_ht", "time_horizon"), "risk_trajectory": show("_tt", "risk_trajectory")}).drop("_lang", "_h", "_t", "_ht", "_tt", "known")


def leaderboard(reports: DataFrame, k: int = 20) -> DataFrame:
    return reports.orderBy(F.desc("risk_score"), F.desc("disruption_probability"), "vendor_name", "report_id").limit(k)
