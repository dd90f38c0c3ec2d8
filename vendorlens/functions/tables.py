"""Table functions of the session's SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vendorlens.functions.lexicon import values_sql


def register_tables(spark: SparkSession) -> None:
    """text_signals(text): the signals of a text, for LATERAL joins: ``FROM documents d, LATERAL text_signals(d.text) s``.
    lowered_signals(low): those of a text that is in lower case already.

    Spark plans them as a join with the lexicon, which is broadcast, without a shuffle of the texts. Groups are a GROUP BY over
    it: inside a function they would be grouped, and shuffled, by whole texts. text_signals lowers a text anew for each keyword, since
    Spark puts its argument into the join's condition; for many or long texts lower once, behind an explode that keeps it from being copied there:
    ``FROM documents LATERAL VIEW explode(array(lower(text))) AS low, LATERAL lowered_signals(low) s``.
    """
    head, rows = values_sql("l").split(" AS (VALUES ", 1)
    for name, low in (("text_signals", "lower(t)"), ("lowered_signals", "t")):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS TABLE (ord INT, category STRING, severity STRING, keyword STRING, weight INT, indicator STRING) "
            f"RETURN SELECT l.* FROM VALUES {rows[:-1]} AS {head} WHERE contains({low}, l.keyword)"
        )
