"""Scalar expressions: levels, rounding, colours, clean-up of names and commands."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Least score of each level, the two palettes of display colours of the levels (LOW for any other), and
# the verbs that a command may begin with.
LEVELS = (("CRITICAL", 70), ("HIGH", 50), ("MEDIUM", 25), ("LOW", 0))
PALETTES = {
    "screen": {"CRITICAL": "#FF2D55", "HIGH": "#FF6B00", "MEDIUM": "#F5A623", "LOW": "#00E87A"},
    "engine": {"CRITICAL": "#FF2D55", "HIGH": "#FF9500", "MEDIUM": "#FFCC00", "LOW": "#34C759"},
}
COMMAND_VERBS = ("scan ", "investigate ", "check ")


def risk_level(score: Column) -> Column:
    out = F.lit("LOW")
    for name, least in reversed(LEVELS[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def round_like_binary(x: Column, places: int = 2) -> Column:
    """Round as correctly rounded binary floats are: values a hair under a tie go down."""
    return F.round(x - F.lit(1e-9), places)


def strip(c: Column) -> Column:
    """Without white space at either end (not only blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def vendor_domain(name: Column) -> Column:
    plain = F.replace(strip(F.lower(name)), F.lit(" "), F.lit(""))
    return F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit(".com")))


def command_text(c: Column) -> Column:
    """Lower-cased, without the first of each verb token, trimmed."""
    out = F.lower(c)
    for verb in COMMAND_VERBS:
        out = F.regexp_replace(out, f"(?s)^(.*?){verb}", "$1")
    return strip(out)


def level_colour(level: Column, palette: str = "screen") -> Column:
    colours = PALETTES[palette]
    table = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair])
    return F.coalesce(F.try_element_at(table, level), F.lit(colours["LOW"]))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def register(spark: SparkSession) -> None:
    """risk_level, risk_percent and vendor_domain as SQL functions of the session."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION risk_level(s INT) RETURNS STRING RETURN CASE WHEN s >= 70 THEN 'CRITICAL' WHEN s >= 50 THEN 'HIGH' WHEN s >= 25 THEN 'MEDIUM' ELSE 'LOW' END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION risk_percent(p DOUBLE) RETURNS INT RETURN CAST(floor(p * 100 + 0.5) AS INT)")
    plain = r"replace(regexp_replace(lower(n), '^\\s+|\\s+$', ''), ' ', '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vendor_domain(n STRING) RETURNS STRING RETURN CASE WHEN contains({plain}, '.') THEN {plain} ELSE concat({plain}, '.com') END")
