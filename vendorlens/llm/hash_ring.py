"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has NODES places on a ring, from its number alone, and each key one, from itself alone. A row belongs to the first node
clockwise of its key; the ring's arcs end at its nodes. A shard takes rows up to its bound, arc by arc along the ring, and
rows that overflow a full shard continue clockwise to the next node whose shard has room. With no slack the bounds add up to the number of
rows, so the shards' counts are at most one apart; with slack a bound is that share more than the mean, and fewer rows move.

Only the number of rows of each arc is needed to say what happens to them: the arcs are a fixed number (shards
times nodes), so their counts come to the driver, are walked there, and give ranges of places in an arc that go to one shard. A row's place
in its arc comes from a sort by ranges over all tasks; no arc is held by one task, and no row comes to the driver.

Defined cases: null keys are one key; rows that share a key have one place on the ring and are apart in it by their text's checksum and size (rows alike in
all three are interchangeable); null texts are empty; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.common import numbered, saved

#: Places of each shard on the ring.
NODES = 256
#: Places on the ring.
RING = 1 << 32


def node_places(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of all nodes along the ring. Those of a shard depend on its number alone."""
    place = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:4], "big")
    return sorted((place(s, v), s) for s in range(shards) for v in range(nodes))


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most rows that each shard takes."""
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walked(counts: dict[int, int], ring: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, slot): rows [from, to) of an arc go to a shard, where the first has the slot.

    First every shard takes rows of its own arcs, then those that overflow go on clockwise, both along the ring.
    """
    room, taken, out = list(room), [0] * len(room), []
    own: list[list[int]] = [[] for _ in room]
    for arc, (_, shard) in enumerate(ring):
        own[shard].append(arc)

    def take(arc: int, start: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            out.append((arc, start, start + n, shard, taken[shard]))
            taken[shard] += n
            room[shard] -= n
        return n

    over = []
    for arc, (_, shard) in enumerate(ring):
        n = counts.get(arc, 0)
        if (done := take(arc, 0, n, shard)) < n:
            over.append((arc, done, n))
    for arc, start, n in over:
        at = arc
        while start < n:  # the next node with room; the bounds leave room for every row

            def ahead(s: int) -> int:
                k = bisect.bisect_right(own[s], at)  # noqa: B023
                return (own[s][k % len(own[s])] - at - 1) % len(ring)  # noqa: B023

            shard = min((s for s, r in enumerate(room) if r), key=ahead)
            at = (at + 1 + ahead(shard)) % len(ring)
            start += take(arc, start, n - start, shard)
    return out


def ring_place(key: Column) -> Column:
    """The place of a key on the ring: the first 32 bits of its sha256."""
    return F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 8), 16, 10).cast("long")


def sharded(documents: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """(id, size, text_crc32, home, shard, slot) of each row: bytes of its text and one, the shard of its first node, the shard
    that took it, and its place there, from 0 without gaps."""
    spark = documents.sparkSession
    ring = node_places(shards, nodes)
    places = np.array([p for p, _ in ring], np.int64)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), ring_place(F.col(id_col)).alias("place"))

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # the first node at or after each place
            arc = np.searchsorted(places, batch.column("place").to_numpy()) % len(places)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc, pa.int32())], names=[*batch.schema.names, "arc"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = saved(rows.mapInArrow(arcs, f"id {kind}, size long, text_crc32 long, place long, arc int"), "ring-rows")
    counts = {r.arc: r.n for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # at most shards * nodes rows
    plan = walked(counts, ring, bounds(sum(counts.values()), shards, slack))
    ranges = spark.createDataFrame(plan, "_arc int, _from long, _to long, shard int, _slot long")  # at most arcs + 2 * shards rows
    found = numbered(rows, "arc", ["place", "id", "text_crc32", "size"], "ring-sorted")
    home = F.element_at(F.lit([s for _, s in ring]), F.col("arc") + 1).cast("int")
    joined = found.join(F.broadcast(ranges), (F.col("arc") == F.col("_arc")) & (F.col("_pos") >= F.col("_from")) & (F.col("_pos") < F.col("_to")))
    return joined.select("id", "size", "text_crc32", home.alias("home"), "shard", (F.col("_slot") + F.col("_pos") - F.col("_from")).alias("slot"))
