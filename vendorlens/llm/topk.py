"""Exact top-k by inner product with a KD-tree per shard.

Vectors become integers and are dealt to shards of bounded size, near ones together: median splits of a bounded sample lay
out the shards, and every vector goes where they send it. Each shard is split at medians
into a tree whose nodes have tight bounding boxes; it is kept as a row of a table. A query walks
a tree best first: the largest inner product that any point of a box can have bounds the box,
and the walk ends when no open box reaches the kth score found. The kth score is
propagated: first each query looks only at the best leaf of each shard, which gives a kth score over all
shards; with it the full walk starts in the shards whose box reaches it, and these send only what reaches it.

Queries go to the shards in blocks of QUERY_BLOCK, a pass over the index for each block, so
what is broadcast does not grow with the data.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part;
only vectors of a query's length are compared with it; ties go to the smaller id; rows that share
an id are one query (the least vector) and each a candidate, but none for the query of that id; rows
with a null id take no part; scores must fit 64 bits; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorlens.llm.common import partitions_for, saved

#: Vectors of a shard, of a leaf, and queries of a block.
SHARD = 4096
LEAF = 256
QUERY_BLOCK = 4096
#: Components of the sample that lays out the shards; splits go on to so many vectors of it.
LAYOUT_COMPONENTS, LAYOUT_LEAF = 1 << 20, 16

INDEX = "dim int, ids binary, vectors binary, lows binary, highs binary, lefts binary, rights binary, starts binary, stops binary"


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Nodes in arrays: tight boxes, children (-1 for leaves) and ranges of the rows, which are put in order."""
    order = np.arange(len(ids))
    lows, highs, lefts, rights, starts, stops = [], [], [], [], [], []

    def node(lo: int, hi: int) -> int:
        own = vectors[order[lo:hi]]
        me = len(lows)
        low, high = own.min(0), own.max(0)
        for column, value in ((lows, low), (highs, high), (lefts, -1), (rights, -1), (starts, lo), (stops, hi)):
            column.append(value)
        if hi - lo > leaf:
            axis = int((high.astype(np.float64) - low).argmax())
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid)]
            lefts[me] = node(lo, lo + mid)
            rights[me] = node(lo + mid, hi)
        return me

    node(0, len(ids))
    return {"ids": ids[order], "vectors": vectors[order], "lows": np.array(lows), "highs": np.array(highs), "lefts": np.array(lefts), "rights": np.array(rights), "starts": np.array(starts), "stops": np.array(stops)}


class Layout:
    """Median splits of a sample: ``codes`` numbers the places of vectors, near ones with near numbers."""

    def __init__(self, sample: np.ndarray, places: int, leaf: int = LAYOUT_LEAF):
        self.axis, self.cut, self.down, self.leaves = [], [], [], 0

        def node(own: np.ndarray, places: int) -> int:
            me = len(self.axis)
            axis = int(np.ptp(own.astype(np.float64), 0).argmax()) if len(own) else 0
            cut = np.partition(own[:, axis], len(own) // 2)[len(own) // 2] if len(own) else 0
            left = own[:, axis] < cut
            split = places > 1 and len(own) >= 2 * leaf and left.any()
            self.axis.append(axis if split else -1)
            self.cut.append(cut)
            self.down.append([self.leaves, 0])
            if split:
                half = (places + 1) // 2
                self.down[me] = [node(own[left], half), node(own[~left], half)]
            else:
                self.leaves += 1
            return me

        node(sample, places)
        self.axis, self.cut, self.down = np.array(self.axis), np.array(self.cut), np.array(self.down)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(vectors), np.int64), np.arange(len(vectors))
        while (inner := self.axis[at] >= 0).any():
            right = vectors[rows, np.maximum(self.axis[at], 0)] >= self.cut[at]
            at = np.where(inner, self.down[at, right.astype(np.int64)], at)
        return self.down[at, 0]


def layouts(vectors: DataFrame) -> dict[int, Layout]:
    """A layout for each length of vectors (id, v) that needs more than one shard."""
    sizes = {r.dim: r.n for r in vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    many = {d: n for d, n in sizes.items() if n > SHARD}
    if not many:
        return {}
    share = min(1.0, LAYOUT_COMPONENTS / sum(d * n for d, n in many.items()))
    chosen = vectors.where(F.size("v").isin(list(many)) & (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) <= int(share * (1 << 30))))
    sample: dict[int, list] = {}
    for r in sorted(chosen.collect()):  # about LAYOUT_COMPONENTS numbers
        sample.setdefault(len(r.v), []).append(r.v)
    return {d: Layout(np.array(x, np.int64), -(-many[d] // SHARD)) for d, x in sample.items()}


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point only where that is exact."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * vectors.shape[1]
    if most < 2**52:
        return np.rint(vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return (vectors * query).sum(1)


def bounds(lows: np.ndarray, highs: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The largest inner product that a point of each box can have."""
    return np.maximum(lows * query, highs * query).sum(1)


def reaching(low: np.ndarray, high: np.ndarray, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """The queries (row numbers) for which a point of the box can reach the floor."""
    step = max(1, (1 << 18) // len(low))
    best = [np.maximum(low * queries[k : k + step], high * queries[k : k + step]).sum(1) for k in range(0, len(queries), step)]
    return np.flatnonzero(np.concatenate(best) >= floors)


def search(tree: dict[str, np.ndarray], query_id: int, query: np.ndarray, k: int, floor: int | None, leaves: int | None = None) -> list[tuple[int, int]]:
    """The best (score, id) of a tree, at most k; only those that reach ``floor``. ``leaves``: look at so many only."""
    box = bounds(tree["lows"], tree["highs"], query)
    open_, best = [(-int(box[0]), 0)], []  # best: a heap of (score, -id), the worst first
    while open_:
        bound, at = heapq.heappop(open_)
        worst = best[0][0] if len(best) == k else floor
        if worst is not None and -bound < worst:
            break
        if tree["lefts"][at] >= 0:
            for child in (int(tree["lefts"][at]), int(tree["rights"][at])):
                heapq.heappush(open_, (-int(box[child]), child))
            continue
        lo, hi = tree["starts"][at], tree["stops"][at]
        score, ids = products(tree["vectors"][lo:hi], query), tree["ids"][lo:hi]
        good = ids != query_id
        if worst is not None:
            good &= score >= worst
        score, ids = score[good], ids[good]
        if len(score) > k:
            top = np.lexsort((ids, -score))[:k]
            score, ids = score[top], ids[top]
        for s, i in zip(score.tolist(), ids.tolist(), strict=True):
            if len(best) < k:
                heapq.heappush(best, (s, -i))
            elif (s, -i) > best[0]:
                heapq.heapreplace(best, (s, -i))
        if leaves is not None:
            leaves -= 1
            if leaves <= 0:
                break
    return [(s, -i) for s, i in best]


def integers(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(id, v): floor(scale * x) of each component x as double, for the vectors that take part."""
    v = F.transform(F.col("v"), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(finite, F.lit(False))).select("id", v.cast("array<long>").alias("v"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, vectors) of the vectors of each length in column 1."""
    lists = batch.column(1)
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    begin = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        yield dim, own, flat[begin[own][:, None] + np.arange(dim)]


def near_together(vectors: DataFrame) -> DataFrame:
    """(id, v) in partitions and order of the layouts; a place that very many vectors share is split by their ids."""
    found = layouts(vectors)
    if not found:
        return vectors
    shared = vectors.sparkSession.sparkContext.broadcast(found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for dim, rows, v in _rows(batch) if batch.num_rows else ():
                if dim in shared.value:
                    code[rows] = shared.value[dim].codes(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code)], names=["id", "v", "code"])

    coded = saved(vectors.mapInArrow(scan, "id long, v array<long>, code long"), "topk-codes")
    order = [F.size("v"), F.col("code"), F.xxhash64("id")]
    return coded.repartitionByRange(partitions_for(vectors), *order).sortWithinPartitions(*order).select("id", "v")


def build_index(vectors: DataFrame) -> DataFrame:
    """The trees of (id, v) as a table (INDEX), one row for each shard."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def row(dim: int) -> pa.RecordBatch:
            own = held.pop(dim)
            tree = build_tree(np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.int64))
            names = ["ids", "vectors", "lows", "highs", "lefts", "rights", "starts", "stops"]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([tree[n].astype(np.int64).tobytes()], pa.binary()) for n in names)], names=["dim", *names])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for dim, rows, v in _rows(batch) if batch.num_rows else ():
                for i, own in zip(ids[rows].tolist(), v, strict=True):
                    held.setdefault(dim, []).append((i, own))
                    if len(held[dim]) == SHARD:
                        yield row(dim)
        for dim in list(held):
            yield row(dim)

    return saved(near_together(vectors).mapInArrow(scan, INDEX), "topk-index")


def _walk(queries: dict[int, tuple[np.ndarray, np.ndarray]], floors: dict[int, int], k: int, leaves: int | None):
    names = [x.split()[0] for x in INDEX.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if dim not in queries.value:
                    continue
                tree = {n: np.frombuffer(row[n], np.int64) for n in names[1:]}
                for n in ("vectors", "lows", "highs"):
                    tree[n] = tree[n].reshape(-1, dim)
                names_, asked = queries.value[dim]
                least = np.array([floors.value.get(q, np.iinfo(np.int64).min) for q in names_.tolist()])
                reach = reaching(tree["lows"][0], tree["highs"][0], asked, least)
                found = [(int(names_[j]), i, s) for j in reach.tolist() for s, i in search(tree, int(names_[j]), asked[j], k, floors.value.get(int(names_[j])), leaves)]
                yield pa.RecordBatch.from_arrays([pa.array([int(f[n]) for f in found], pa.int64()) for n in range(3)], names=["query_id", "vec_id", "score"])

    return scan


def top_k(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query (id, v) over all shards of the index."""
    spark = index.sparkSession
    asked = saved(queries.groupBy("id").agg(F.min("v").alias("v")), "topk-queries")
    shards = index.repartition(partitions_for(index))
    found: list[DataFrame] = []
    rows = asked.orderBy("id").toLocalIterator(prefetchPartitions=False)
    block: list = []

    def run() -> None:
        by_dim: dict[int, tuple[list, list]] = {}
        for r in block:
            own = by_dim.setdefault(len(r.v), ([], []))
            own[0].append(r.id)
            own[1].append(r.v)
        shared = spark.sparkContext.broadcast({d: (np.array(i, np.int64), np.array(v, np.int64)) for d, (i, v) in by_dim.items()})
        schema = "query_id long, vec_id long, score long"
        first = ranked(shards.mapInArrow(_walk(shared, spark.sparkContext.broadcast({}), k, 1), schema), k)
        kth = first.where(F.col("rank") == k).select("query_id", "score").collect()  # at most QUERY_BLOCK rows
        floors = spark.sparkContext.broadcast({r.query_id: r.score for r in kth})
        found.append(saved(ranked(shards.mapInArrow(_walk(shared, floors, k, None), schema), k), "topk-found"))
        block.clear()

    for r in rows:
        block.append(r)
        if len(block) == QUERY_BLOCK:
            run()
    if block or not found:
        run()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query: larger scores, then smaller ids."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, **columns) -> DataFrame:
    """top_k with the rows for which ``is_query`` (on ``id``) holds as queries and all rows as candidates."""
    vectors = integers(embeddings, **columns)
    return top_k(build_index(vectors), vectors.where(is_query), k)
