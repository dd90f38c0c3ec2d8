"""The default risk lexicon as a table: ord, category, severity, keyword, weight, indicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severities with their weights, and the keywords of each category and severity in
# declared order. Keywords with capitals never match lower-cased text unless they are folded.
SEVERITY_WEIGHTS = {"critical": 35, "high": 20, "medium": 10, "low": 3}
CATEGORIES = ("financial", "operational", "legal", "reputational", "cybersecurity")
KEYWORDS = (
    ("financial", "critical", ("bankruptcy", "insolvency", "chapter 11", "chapter 7", "liquidation", "default", "debt restructuring", "financial collapse", "insolvent")),
    ("financial", "high", ("financial distress", "cash flow problems", "massive losses", "debt crisis", "credit downgrade", "junk rating", "bond default", "revenue decline")),
    ("financial", "medium", ("cost cutting", "budget cuts", "financial pressure", "losses", "debt increase", "declining revenue", "profitability concerns", "write-down")),
    ("financial", "low", ("restructuring", "strategic review", "cost optimization", "efficiency measures")),
    ("operational", "critical", ("shutdown", "factory closure", "operations halted", "production stopped", "supply chain collapse", "critical failure")),
    ("operational", "high", ("major layoffs", "mass redundancies", "facility closure", "production delays", "supply shortage", "operational disruption")),
    ("operational", "medium", ("hiring freeze", "workforce reduction", "operational challenges", "capacity reduction", "delays")),
    ("operational", "low", ("restructuring", "reorganization", "headcount adjustment")),
    ("legal", "critical", ("criminal charges", "fraud conviction", "sanctions", "regulatory shutdown", "license revoked", "SEC enforcement")),
    ("legal", "high", ("major lawsuit", "class action", "regulatory investigation", "DOJ probe", "SEC investigation", "fraud allegations", "antitrust violation")),
    ("legal", "medium", ("legal dispute", "lawsuit", "regulatory warning", "compliance issues", "fine", "penalty")),
    ("legal", "low", ("legal review", "regulatory inquiry", "compliance review")),
    ("reputational", "critical", ("scandal", "corruption exposed", "massive fraud", "executive arrested")),
    ("reputational", "high", ("public backlash", "brand crisis", "customer exodus", "viral negative", "boycott", "major controversy")),
    ("reputational", "medium", ("negative press", "customer complaints", "PR crisis", "negative reviews")),
    ("reputational", "low", ("criticism", "concerns raised", "negative sentiment")),
    ("cybersecurity", "critical", ("data breach", "ransomware attack", "critical vulnerability exploited", "systems compromised", "cyber attack")),
    ("cybersecurity", "high", ("security breach", "hacked", "data leak", "vulnerability exposed")),
    ("cybersecurity", "medium", ("security incident", "data exposure", "security concerns")),
    ("cybersecurity", "low", ("security review", "vulnerability patched")),
)

SCHEMA = "ord INT, category STRING, severity STRING, keyword STRING, weight INT, indicator STRING"


def default_rows() -> list[tuple[int, str, str, str, int, str]]:
    flat = [(c, s, k) for c, s, ks in KEYWORDS for k in ks]
    return [(i, c, s, k, SEVERITY_WEIGHTS[s], k.title()) for i, (c, s, k) in enumerate(flat)]


def lexicon(spark: SparkSession, rows: list | None = None, *, fold_keywords: bool = False) -> DataFrame:
    """The lexicon table; ``fold_keywords`` lower-cases the keywords, so that all can match."""
    df = spark.createDataFrame(default_rows() if rows is None else rows, SCHEMA)
    return df.withColumn("keyword", F.lower("keyword")) if fold_keywords else df


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows no letter, lower-case the others (write-down: Write-Down)."""
    return F.array_join(F.transform(F.split(F.lower(c), r"(?<=[^\p{L}])"), F.initcap), "")


def values_sql(alias: str = "lexicon") -> str:
    """The lexicon as a VALUES list, for SQL."""
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"{alias}(ord, category, severity, keyword, weight, indicator) AS (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in default_rows())})"
