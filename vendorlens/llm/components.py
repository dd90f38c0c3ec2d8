"""Connected components as DataFrame jobs: local contraction, then alternating large and small stars.

First every task replaces the edges it happens to hold, a bounded number at a time, by a star
for each group that they connect (so a group of copies becomes one star in most tasks). Then each
round only takes minima per node (summed up before the shuffle) and joins them back to the
edges, so a node with very many edges is never gathered in one task. Each round is written to
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vendorlens.llm.common import saved

#: Edges that a task contracts at a time.
CONTRACT = 200_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) for every node that some edge connects to a smaller one."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    tail = root != np.arange(len(nodes))
    return nodes[tail], nodes[root[tail]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def done() -> pa.RecordBatch:
        a, b = stars(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append(tuple(batch.column(i).cast(batch.schema.field(i).type).to_numpy(zero_copy_only=False) for i in (0, 1)))
        if sum(len(h[0]) for h in held) >= CONTRACT:
            yield done()
    if held:
        yield done()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    ``edges`` has columns a and b, both of numbers or of strings. Rows with a null end and loops link
    nothing; repeated and reversed edges count once. Without edges the result is empty.
    """
    kind = edges.schema["a"].dataType.simpleString()
    links = edges.where("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(_contracted, f"a {kind}, b {kind}")
    before = None
    links = saved(links, f"{name}-edges")
    while True:
        # large star: every larger neighbour of a node goes to the least of its neighbourhood
        both = links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # small star: a node's smaller neighbours and itself go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("m", F.explode(F.array("a", "b")).alias("a"))
        done = Observation()
        round_ = small.where("a <> m").select("a", F.col("m").alias("b")).distinct()
        links = saved(round_.observe(done, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")), f"{name}-round")
        if done.get == before:
            break
        before = done.get
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
