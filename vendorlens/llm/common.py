"""Helpers that the training-data operators share: tables, durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text taken into one numpy block, in bytes. A longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where the session has none, a temporary folder is set if all runs on this machine (tests); a
    cluster must name one, since each machine would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back. ``options``: those of the writer.

    It cuts the lineage, and what was written survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` as a table in the shared folder, with _pos, from 0 without gaps within ``group`` (null is a group too) by ``order``
    (nulls first), and _size, the rows of the group.

    Rows are sorted by ranges, equal rows included, so that a group of any size lies in many tasks; only counts of
    (range, group) are summed up over ranges. Rows equal in ``order`` are numbered in any order.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranges = tied.repartitionByRange(partitions_for(df), group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    stored = saved(ranges.withColumn("_at", F.monotonically_increasing_id()), name)  # range << 33 | place in the range
    part = F.shiftright("_at", 33)
    counts = stored.groupBy(part.alias("_part"), F.col(group).alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_of")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", "_of", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_size"))
    rows = stored.join(counts, (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_of")))
    return rows.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("_pos"), "_size")


#: Text that goes to a Python worker at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have the session send at most BATCH_BYTES to a Python worker at once, however long the texts are.

    For applications (the registered queries and the pipeline call it); operators leave the session as it is.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def partitions_for(df: DataFrame, floor: int = 1) -> int:
    """Shuffle partitions for work keyed by hand: the session's setting."""
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Bits of the filter below (4 MB), and of one of its rows.
FILTER_BITS, ROW_BITS = 1 << 25, 1 << 15


def id_bits(ids: DataFrame, column: str = "id") -> DataFrame:
    """The ids as a table of bits (_k, _bits) for ``sifted``: FILTER_BITS bits however many ids there are."""
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))
    at = ids.where(F.col(column).isNotNull()).select(place.alias("p"))
    parts = at.groupBy((F.col("p") / ROW_BITS).cast("long").alias("k")).agg(F.bitmap_construct_agg(F.col("p") % ROW_BITS).alias("bits")).collect()  # at most 1024 rows of 4 KB
    rows = pa.table({"_k": pa.array([r.k for r in parts], pa.int64()), "_bits": pa.array([np.frombuffer(r.bits, "<i8") for r in parts], pa.list_(pa.int64()))})
    return ids.sparkSession.createDataFrame(rows, "_k long, _bits array<long>")


def sifted(df: DataFrame, bits: DataFrame, column: str = "id", how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``column`` is among the ids of ``id_bits``, and few others: for use before a join.
    ``left_anti`` gives exactly the other rows.

    With very many ids more rows pass and none is lost. The bits are a broadcast table of at most
    1024 rows, so the test runs in the JVM; no row is shuffled or sent to Python for it.
    """
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))
    inside = place % ROW_BITS
    word = F.get(F.col("_bits"), F.shiftright(inside, 6).cast("int"))
    known = F.call_function("shiftright", word, (inside % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(bits), (F.shiftright(place, 15) == F.col("_k")) & known, how)
