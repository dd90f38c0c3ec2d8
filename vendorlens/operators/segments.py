"""Neighbours in an ordered history that many tasks share.

A history (the rows of a key) is cut into segments by a column that grows with its order, such as the month of a time. Rows
look at their neighbours inside a segment, and each segment's end is carried to the next one, so that the largest sort is a
segment and only one row a segment is sorted by the whole key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_segment(ts: Column, days: float) -> Column:
    """Which stretch of so many days a time lies in; null for null."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(int(days * 86_400_000_000))).cast("long")


def on_same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of the columns of two tables, null being equal to null."""
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in names])


def neighbour(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], segment: Column, *, ahead: bool = False) -> DataFrame:
    """``df`` with columns of the row before (or ``ahead``: after) in the order of the key; ``columns``: new name to column.

    ``order`` should tell rows of a key apart; ``segment`` must not fall when the order rises. Nulls come first, as in a window.
    """
    own = [*keys, "_segment"]
    rows = df.withColumn("_segment", segment)
    found = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    inside = Window.partitionBy(*own).orderBy(*order)
    near = (F.lead if ahead else F.lag)(found).over(inside)
    place = F.struct(*order)
    ends = rows.groupBy(*own).agg((F.min_by if ahead else F.max_by)(found, place).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_segment")
    ends = ends.withColumn("_carried", (F.lead if ahead else F.lag)("_end").over(over)).drop("_end")
    rows = rows.withColumn("_near", near)
    ends = ends.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(own)], "_carried")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(own)])
    joined = rows.join(ends, same, "left")
    # a row without a neighbour in its segment is at its edge
    return joined.select(*df.columns, *[F.coalesce(F.col("_near"), F.col("_carried"))[n].alias(n) for n in columns])
