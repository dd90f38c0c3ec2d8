"""Scores, groups and rollups of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlens.functions.lexicon import title_case
from vendorlens.functions.scalars import risk_level, round_like_binary

# Fixed values of the scoring formulas.
NO_SIGNALS = {"risk_score": 5, "risk_level": "LOW", "confidence_score": 0.3, "disruption_probability": 0.05}
FULL_CONFIDENCE_SIGNALS = 15
CRITICAL_BONUS, JOINT_BONUS, MOST_DISRUPTION = 0.2, 0.15, 0.99


def confidence(n_categories: Column, n_signals: Column, categories: int = 5) -> Column:
    return F.round(F.lit(0.5) * (n_categories / F.lit(categories)) + F.lit(0.5) * F.least(F.lit(1.0), n_signals / F.lit(FULL_CONFIDENCE_SIGNALS)), 2)


def disruption(score: Column, critical: Column, joint: Column) -> Column:
    factor = F.lit(1.0) + F.when(critical, CRITICAL_BONUS).otherwise(0.0) + F.when(joint, JOINT_BONUS).otherwise(0.0)
    return round_like_binary(F.least(F.lit(MOST_DISRUPTION), score / F.lit(100) * factor))


def score_signals(signals: DataFrame, keys: list[str] | str, *, everyone: DataFrame | None = None, categories: int = 5) -> DataFrame:
    """Score, level, confidence and disruption probability for each key.

    ``everyone``: all keys, so that those without signals get the default scores.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    has = lambda c, v: F.coalesce(F.bool_or(F.col(c) == v), F.lit(False))
    found = signals.groupBy(*keys).agg(
        F.least(F.lit(100), F.sum("weight")).cast("int").alias("risk_score"),
        F.count("*").alias("n_signals"),
        F.countDistinct("category").alias("n_categories"),
        has("severity", "critical").alias("has_critical"),
        (has("category", "financial") & has("category", "operational")).alias("joint"),
    )
    if everyone is not None:
        found = everyone.select(*keys).distinct().join(found, keys, "left")
    none = F.col("n_signals").isNull()
    return found.select(
        *keys,
        F.coalesce("risk_score", F.lit(NO_SIGNALS["risk_score"])).alias("risk_score"),
        F.when(none, NO_SIGNALS["risk_level"]).otherwise(risk_level(F.col("risk_score"))).alias("risk_level"),
        F.when(none, NO_SIGNALS["confidence_score"]).otherwise(confidence(F.col("n_categories"), F.col("n_signals"), categories)).alias("confidence_score"),
        F.when(none, NO_SIGNALS["disruption_probability"]).otherwise(disruption(F.col("risk_score"), F.col("has_critical"), F.col("joint"))).alias("disruption_probability"),
        F.coalesce("n_signals", F.lit(0)).alias("n_signals"),
        F.coalesce("n_categories", F.lit(0)).alias("n_categories"),
    )


def signal_groups(signals: DataFrame, keys: list[str] | str, *, indicators: int = 5, counts: bool = False) -> DataFrame:
    """(keys, category, severity, indicators, weight, ord): one row for each category of a key; with ``counts`` also n, its signals.

    The severity is the highest one, indicators are the first distinct ones in lexicon order, and
    ``ord`` (the first entry's place) keeps the order of categories with equal weights.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = F.array_sort(F.collect_list(F.struct("ord", "indicator")))
    return signals.groupBy(*keys, "category").agg(
        F.upper(F.max_by("severity", F.struct("weight", -F.col("ord")))).alias("severity"),
        F.slice(F.array_distinct(F.transform(rows, lambda x: x.indicator)), 1, indicators).alias("indicators"),
        F.sum("weight").alias("weight"),
        F.min("ord").alias("ord"),
        *([F.count("*").alias("n")] if counts else []),
    ).withColumn("category", title_case(F.col("category")))


def grouped_arrays(groups: DataFrame, keys: list[str] | str) -> DataFrame:
    """(keys, signals): the groups of a key as an array, heaviest first."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    item = F.struct((-F.col("weight")).alias("w"), "ord", "category", "severity", "indicators", "weight")
    return groups.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x.category.alias("category"), x.severity.alias("severity"), x.indicators.alias("indicators"), x.weight.alias("weight"))).alias("signals"))


def scored_groups(signals: DataFrame, keys: list[str] | str, *, categories: int = 5) -> DataFrame:
    """What score_signals and grouped_arrays say of each key with signals, from one pass over the signals."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    groups = signal_groups(signals, keys, counts=True)
    item = F.struct((-F.col("weight")).alias("w"), "ord", "category", "severity", "indicators", "weight")
    has = lambda c, v: F.bool_or(F.col(c) == v)
    found = groups.groupBy(*keys).agg(
        F.least(F.lit(100), F.sum("weight")).cast("int").alias("risk_score"), F.sum("n").alias("n_signals"), F.count("*").alias("n_categories"), has("severity", "CRITICAL").alias("critical"),
        (has("category", "Financial") & has("category", "Operational")).alias("joint"), F.array_sort(F.collect_list(item)).alias("x"),
    )
    plain = F.transform("x", lambda x: F.struct(x.category.alias("category"), x.severity.alias("severity"), x.indicators.alias("indicators"), x.weight.alias("weight")))
    return found.select(
        *keys, "risk_score", risk_level(F.col("risk_score")).alias("risk_level"), confidence(F.col("n_categories"), F.col("n_signals"), categories).alias("confidence_score"),
        disruption(F.col("risk_score"), F.col("critical"), F.col("joint")).alias("disruption_probability"), "n_signals", "n_categories", plain.alias("signals"),
    )


def with_no_signals(scores: DataFrame) -> DataFrame:
    """The scores of keys without signals filled in (rows of an outer join)."""
    fill = {c: F.lit(v) for c, v in NO_SIGNALS.items()} | {"n_signals": F.lit(0), "n_categories": F.lit(0)}
    return scores.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def rollup_signals(signals: DataFrame, vendor_col: str, *, approximate: bool = False) -> DataFrame:
    """Vendors hit and total weight for each category and severity, with subtotals and the grand total; ``approximate``: vendors
    within some 2 % instead of exactly, from sketches of fixed size instead of all distinct pairs."""
    vendors = F.approx_count_distinct(vendor_col, 0.02) if approximate else F.countDistinct(vendor_col)
    return signals.cube("category", "severity").agg(F.grouping_id().alias("grouping"), vendors.alias("vendors"), F.sum("weight").alias("total_weight"))


#: Base-2 logarithm of a sketch's slots: about 0.8 % standard error in some 16 KB.
SKETCH_BITS = 14


def daily_sketches(signals: DataFrame, vendor_col: str, day_col: str = "day") -> DataFrame:
    """(day, category, severity, vendors, weight): a mergeable sketch of the vendors hit and the weight of each day.

    Kept as a table, a day's rows are worked out once; any span of days, with any subtotals, is a rollup of them."""
    return signals.groupBy(day_col, "category", "severity").agg(F.hll_sketch_agg(vendor_col, SKETCH_BITS).alias("vendors"), F.sum("weight").alias("weight"))


def rollup_sketches(sketches: DataFrame) -> DataFrame:
    """(category, severity, grouping, vendors, total_weight) of daily_sketches, as rollup_signals gives for the signals of their days."""
    united = F.hll_sketch_estimate(F.hll_union_agg("vendors"))
    return sketches.cube("category", "severity").agg(F.grouping_id().alias("grouping"), united.alias("vendors"), F.sum("weight").alias("total_weight"))
