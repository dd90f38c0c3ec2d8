"""Near-duplicates by chosen-path set similarity join over MinHash values.

Every document is its set of distinct word shingles, kept as minwise tokens (one for each of
128 hash functions). A node of a tree chooses BRANCH of the functions, by its own name alone,
and sends each of its documents to one child for each chosen function, named by the token
found there. Two documents of similarity s meet in a child with chance s for each choice, so
a pair at or over the threshold has more than one child in common on average and keeps meeting
at any depth, while others part quickly. Nodes with at most LEAF * LEAF pairs to compare are
compared exhaustively, in tiles of at most TILE documents and those that they are compared with, so no
task holds a whole node; larger ones branch again, unless their children together would have nearly as many pairs. TREES independent trees give the recall:
``missed_per_tree(0.8, 2)`` is 0.0625, so 7 trees miss 4 of a thousand million pairs.

Candidates are confirmed on full shingle sets. Documents with the same set are one node of the
graph (its least id), so copies are never paired; within a node of the tree documents are first
compared to its least id, and what is already connected is not compared again: the classes come
out whole without all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.common import id_bits, partitions_for, saved, sifted
from vendorlens.llm.components import connected_components
from vendorlens.llm.words import Block, blocks, mix, windows

FUNCTIONS = 128
BRANCH = 2
TREES = 7
#: Branching before the first comparison, and the size up to which a node is compared whole (its pairs, LEAF * LEAF).
FIRST_DEPTH = 2
LEAF = 2048
#: Documents of a node that one task compares, with at most PROBES others.
TILE, PROBES = 512, 2048
#: A large node branches if its children have at most this share of its pairs.
PAYS = 0.9
#: At this depth larger nodes are compared too, in as many tiles as it takes.
LAST_DEPTH = 12
#: Of 128 minwise tokens, how many must agree before two documents are looked at: 4.5 deviations under 0.8.
AGREE = 82
#: Of FINE tokens (taken only for documents that are compared within a node), how many must agree
#: before two sets are fetched: 4 deviations under 0.8.
FINE, FINE_AGREE = 512, 373
#: Sketches compared to one leader in one task, and full sets.
STAR, CONFIRMED = 2048, 256

_SEEDS = mix(np.arange(1, FINE + 1, dtype=np.uint64))
_MULTIPLY = (_SEEDS & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_ADD = (_SEEDS >> np.uint64(32)).astype(np.uint32)


def missed_per_tree(similarity: float, branch: int = BRANCH) -> float:
    """Chance that a pair meets in no node of a tree, however deep: q = (1 - s + s q) ** branch."""
    q = 0.0
    for _ in range(10_000):
        q = (1 - similarity + similarity * q) ** branch
    return q


def shingle_sets(block: Block, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a block; fewer words than ``width``: the whole
    sequence as one; no words: empty."""
    h = block.hashes()
    start, win = windows(h, block.first, width)
    cut = np.searchsorted(start, block.first)
    for i in range(block.hi - block.lo):
        lo, hi = block.first[i], block.first[i + 1]
        if hi == lo:
            yield np.empty(0, np.uint64)
        elif hi - lo < width:
            yield windows(h[lo:hi], np.array([0, hi - lo]), int(hi - lo))[1]
        else:
            own = np.sort(win[cut[i] : cut[i + 1]])
            yield own[np.append(True, own[1:] != own[:-1])]


def minwise(shingles: np.ndarray, functions: int = FUNCTIONS) -> np.ndarray:
    """The least of each hash function over the set: its chosen token, as 32 bits."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(functions, 0xFFFFFFFF, np.uint32)
    multiply, add = _MULTIPLY[:functions, None], _ADD[:functions, None]
    for at in range(0, len(short), 1024):
        np.minimum(out, (multiply * short[None, at : at + 1024] + add).min(1), out=out)
    return out


def _signatures(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), "space", True):
                n, k1, k2, sig = [], [], [], []
                for own in shingle_sets(block, width):
                    n.append(len(own))
                    k1.append(int(mix(own).sum(dtype=np.uint64)))
                    k2.append(int(mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)))
                    sig.append(minwise(own).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.hi - block.lo), pa.array(n, pa.int64()), pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)), pa.array(sig, pa.binary())],
                    names=["id", "n", "k1", "k2", "sig"],
                )

    return scan


def _sets(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), "space", True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), pa.array([x.tobytes() for x in shingle_sets(block, width)], pa.binary())], names=["id", "shingles"])

    return scan


def _fine(width: int):
    """(id, sketch): the low byte of FINE minwise tokens. Rows: id, text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), "space", True):
                low = [(minwise(x, FINE) & np.uint32(255)).astype(np.uint8).tobytes() for x in shingle_sets(block, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), pa.array(low, pa.binary())], names=["id", "sketch"])

    return scan


def _chosen(node: np.ndarray, k: int) -> np.ndarray:
    """The k-th function that each node chooses."""
    return (mix(node + np.uint64(0x1234567 + k)) % np.uint64(FUNCTIONS)).astype(np.int64)


def _children(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Children (BRANCH to a row) of each row's node, for the row's minwise tokens."""
    out = []
    for k in range(BRANCH):
        f = _chosen(node, k)
        out.append(mix(node * np.uint64(0x9E3779B97F4A7C15) + mix(sig[np.arange(len(sig)), f].astype(np.uint64) + (f.astype(np.uint64) << np.uint64(40)))))
    return np.stack(out, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, FUNCTIONS)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, id) after FIRST_DEPTH levels of every tree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, ids = _matrix(batch.column(1)), batch.column(0)
        for tree in range(TREES):
            node = np.full((batch.num_rows, 1), mix(np.array([tree + 1], np.uint64))[0], np.uint64)
            for _ in range(FIRST_DEPTH):
                node = np.concatenate([_children(node[:, j], sig) for j in range(node.shape[1])], 1)
            flat = node.view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(flat), ids.take(pa.array(np.repeat(np.arange(batch.num_rows), node.shape[1])))], names=["node", "id"])


def _branched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(parent, node, id) of the children of rows (node, id, sig)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        child = _children(node, _matrix(batch.column(2)))
        twice = pa.array(np.repeat(np.arange(batch.num_rows), BRANCH))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(twice), pa.array(child.view(np.int64).ravel()), batch.column(1).take(twice)], names=["parent", "node", "id"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the first ``keys`` columns, cut so that every yielded batch ends with its group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                change[0] |= v[0] != held[-1].column(k)[held[-1].num_rows - 1].as_py()
        cuts = np.flatnonzero(change)
        if len(cuts):
            last = int(cuts[-1])
            done = [*held, *([batch.slice(0, last)] if last else [])]
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bounds(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    change = np.zeros(batch.num_rows + 1, bool)
    change[[0, -1]] = True
    for k in range(keys):
        v = batch.column(k).to_numpy(zero_copy_only=False)
        change[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _sketch(column: pa.Array, functions: int = FUNCTIONS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, functions)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each document and the least of its group (node, salt), if their sketches agree.

    Rows: node, salt, id, sketch; sorted by all but the last.
    """
    leader_key, leader = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        sk = _sketch(batch.column(3))
        cut = _bounds(batch, 2)
        ids = batch.column(2).to_numpy(zero_copy_only=False)
        node, salt = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        owner = np.repeat(cut[:-1], np.diff(cut))
        lead_ids = ids[owner]
        heads = sk[owner]
        if leader_key == (node[0], salt[0]):  # the group began in an earlier batch
            lead_ids[: cut[1]] = leader[0]
            heads[: cut[1]] = leader[1]
        agree = (heads == sk).sum(1) >= AGREE
        ok = agree & (lead_ids != ids)
        last = cut[-2]
        if leader_key != (node[last], salt[last]):
            leader_key, leader = (node[last], salt[last]), (ids[last], sk[last].copy())
        yield pa.RecordBatch.from_arrays([pa.array(lead_ids[ok]), pa.array(ids[ok])], names=["a", "b"])


def _masks(names: np.ndarray, places: np.ndarray, node: int) -> np.ndarray:
    """For each document of a tile, which of its most frequent nodes before ``node`` it is in, as 64 bits; ``names[places[i]:places[i + 1]]`` are
    the nodes of document i."""
    owner = np.repeat(np.arange(len(places) - 1), np.diff(places))
    before = names[places[0] : places[-1]] < node
    own, names = owner[before], names[places[0] : places[-1]][before]
    kinds, which, count = np.unique(names, return_inverse=True, return_counts=True)
    bit = np.full(len(kinds), -1)
    usual = np.argsort(-count, kind="stable")[:64]
    bit[usual] = np.arange(len(usual))
    known = bit[which] >= 0
    out = np.zeros(len(places) - 1, np.uint64)
    np.bitwise_or.at(out, own[known], np.uint64(1) << bit[which][known].astype(np.uint64))
    return out


def _within(most: int | None, compared=None):
    """(a, b) with agreeing sketches and different classes in each tile; of those of a document, the ``most``
    alike. Rows: tile, id, probe, node, class, main, sketch, nodes. Probes are compared with the tile's other
    rows: those of the node's largest class (main), and others of a larger id. ``nodes`` are all nodes of the document at
    this depth, so that a pair is named only by the first node that it shares; nearly all others are told by a few
    bits and not compared. ``compared`` counts the pairs of sketches.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 1):
            _, ids, probe, node, cls, main = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            fine = _sketch(batch.column(6), FINE)
            coarse = np.ascontiguousarray(fine[:, :FUNCTIONS])
            places, names = batch.column(7).offsets.to_numpy(), batch.column(7).values.to_numpy()
            others = lambda i: names[places[i] : places[i + 1]]  # noqa: B023, E731
            cut = _bounds(batch, 1)
            a, b = [np.empty(0, ids.dtype)], [np.empty(0, ids.dtype)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                base = np.flatnonzero(~probe[lo:hi]) + lo
                sketches = coarse[base]
                bits = _masks(names, places[lo : hi + 1], node[lo])
                own_bits = bits[base - lo]
                for i in np.flatnonzero(probe[lo:hi]) + lo:
                    fresh = np.flatnonzero((own_bits & bits[i - lo]) == 0)
                    if compared is not None:
                        compared.add(len(fresh))
                    near = base[fresh]
                    near = near[(sketches[fresh] == coarse[i]).sum(1) >= AGREE]
                    near = near[(cls[near] != cls[i]) & (main[near] | (ids[near] > ids[i]))]
                    alike = (fine[near] == fine[i]).sum(1)
                    good = alike >= FINE_AGREE
                    near, alike = near[good], alike[good]
                    near = near[np.argsort(-alike, kind="stable")]
                    mine = []
                    for j in near.tolist():
                        if most is not None and len(mine) == most:
                            break
                        if np.intersect1d(others(i), others(j), assume_unique=True)[0] == node[i]:
                            mine.append(j)
                    if mine:
                        a.append(np.full(len(mine), ids[i]))
                        b.append(ids[mine])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return scan


def _confirm(percent: int):
    """(a, b) of the pairs whose full sets are similar enough. Rows: a, salt, b, set; the row with b null
    holds a's own set and comes first (several, if an id has several texts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            left, right = [], []
            for a, salt, b, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, salt) != key:
                    key, own = (a, salt), []
                x = np.frombuffer(shingles, np.uint64)
                if b is None:
                    own.append(x)
                    continue
                for y in own:
                    small, big = (x, y) if len(x) < len(y) else (y, x)
                    if 100 * len(small) < percent * len(big) or not len(small):
                        continue
                    at = np.searchsorted(big, small)
                    at[at == len(big)] = 0
                    common = int((big[at] == small).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        left.append(a)
                        right.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return scan


class _Join:
    """The state of one similarity join."""

    def __init__(self, documents: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        self.parts = partitions_for(documents)
        self.documents = documents
        self.signed = saved(documents.mapInArrow(_signatures(width), "id long, n long, k1 long, k2 long, sig binary"), "neardup-signatures")
        firsts = self.signed.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min(F.struct("id", "sig")).alias("x"))
        self.classes = saved(firsts.select("k1", "k2", "x.id", "x.sig"), "neardup-classes")
        self.sets: DataFrame | None = None
        self.links: DataFrame | None = None
        self.compared = documents.sparkSession.sparkContext.accumulator(0)
        self.tried: DataFrame | None = None
        self.labelled: DataFrame | None = None

    def mapped(self, ids: DataFrame, scan, schema: str) -> DataFrame:
        """What ``scan`` makes of the texts of these documents, and of few others; no text is shuffled."""
        return sifted(self.documents, id_bits(ids)).select("id", "text").mapInArrow(scan, schema)

    def fetch(self, ids: DataFrame) -> None:
        """Have the sets of these documents at hand."""
        found = saved(self.mapped(ids, _sets(self.width), "id long, shingles binary").join(ids, "id", "left_semi"), "neardup-sets")
        self.sets = found if self.sets is None else self.sets.unionByName(found)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the similarity on full sets."""
        per_leader = pairs.groupBy("a").agg(F.ceil(F.count("*") / CONFIRMED).alias("salts")).where("salts > 1")
        salted = pairs.join(per_leader, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).cast("int"))
        partners = salted.select("a", "salt", "b").join(self.sets.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "shingles")
        leaders = salted.select("a", "salt").distinct().join(self.sets.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
        rows = partners.unionByName(leaders).repartition(self.parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return saved(rows.mapInArrow(_confirm(self.percent), "a long, b long"), "neardup-links")

    def components(self) -> DataFrame:
        """(id, component) of all documents with links."""
        sketch = self.classes.select("id", F.col("sig"))
        bytes_ = _low_bytes(sketch)
        nodes = saved(self.kept_nodes(self.classes.select("id", "sig").mapInArrow(_roots, "node long, id long")), "neardup-nodes")
        depth = FIRST_DEPTH
        while not nodes.isEmpty():
            salt = F.when(F.col("n") <= STAR, 0).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / STAR)))
            members = nodes.select("node", salt.cast("long").alias("salt"), "id", "n")
            # leaders of the parts of a large node meet in a group of their own
            tops = members.where(f"n > {STAR}").groupBy("node", "salt").agg(F.min("id").alias("id")).select("node", F.lit(-1).cast("long").alias("salt"), "id")
            rows = members.select("node", "salt", "id").unionByName(tops).join(bytes_, "id").select("node", "salt", "id", "sketch")
            stars = rows.repartition(self.parts, "node", "salt").sortWithinPartitions("node", "salt", "id").mapInArrow(_stars, "a long, b long").distinct()
            self.link(stars)
            mixed = self.mixed(nodes)
            grown = self.grown(mixed.where(f"n * rest > {LEAF * LEAF}").select("node", "id", "n").join(sketch, "id")) if depth < LAST_DEPTH else None
            for most in (2, None):  # first the most alike, which connect nearly all; then all that are left
                if most is None:
                    mixed = self.mixed(nodes)
                leaves = mixed
                if grown is not None:  # small nodes, and those for which branching doesn't pay
                    branching = grown.select(F.col("parent").alias("node")).distinct().withColumn("branches", F.lit(True))
                    leaves = mixed.join(branching, "node", "left").where(f"branches is null or n * rest <= {LEAF * LEAF}").drop("branches")
                if leaves.isEmpty():
                    break
                own = saved(leaves.groupBy("id").agg(F.sort_array(F.collect_set("node")).alias("nodes")), "neardup-leaf-nodes")
                fine = saved(self.mapped(own, _fine(self.width), "id long, sketch binary").join(own, "id"), "neardup-fine")
                rows = self.tiles(leaves).join(fine, "id").select("tile", "id", "probe", "node", "class", "main", "sketch", "nodes")
                self.link(rows.repartition(self.parts, "tile").sortWithinPartitions("tile", "id").mapInArrow(_within(most, self.compared), "a long, b long").distinct())
            if grown is None:
                break
            big = mixed.where(f"n * rest > {LEAF * LEAF}").select(F.col("node").alias("parent")).distinct()
            nodes = saved(self.kept_nodes(grown.join(big, "parent", "left_semi").select("node", "id")), "neardup-nodes")
            depth += 1
        return self.labels()

    @staticmethod
    def grown(big: DataFrame) -> DataFrame:
        """(parent, node, id): the children of the large nodes for which branching pays. Texts that are alike but under the threshold
        stay together in many children, which then have more pairs than their node has: such a node is compared itself."""
        children = saved(big.select("node", "id", "sig").mapInArrow(_branched, "parent long, node long, id long"), "neardup-children")
        pairs = children.groupBy("parent", "node").agg(F.count("*").alias("c")).groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
        sizes = big.groupBy(F.col("node").alias("parent")).agg(F.max("n").alias("n"))
        paying = pairs.join(sizes, "parent").where(F.col("pairs") <= PAYS * F.col("n") * F.col("n")).select("parent")
        return children.join(saved(paying, "neardup-paying"), "parent", "left_semi")

    @staticmethod
    def kept_nodes(nodes: DataFrame) -> DataFrame:
        """(node, id, n) of the nodes with two documents or more."""
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
        return nodes.join(sizes.where("lo < hi").select("node", "n"), "node")

    def link(self, pairs: DataFrame) -> None:
        """Confirm the pairs that were not tried before and keep the links."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = saved(pairs, "neardup-pairs")
        if pairs.isEmpty():
            return
        ids = pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()).distinct()
        self.fetch(saved(ids if self.sets is None else ids.join(self.sets.select("id"), "id", "left_anti"), "neardup-ids"))
        found = self.confirm(pairs)
        self.links = found if self.links is None else self.links.unionByName(found)
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        self.labelled = None

    def labels(self) -> DataFrame:
        """(id, component) of all documents with links so far."""
        if self.labelled is None:
            if self.links is None:
                return self.classes.select("id", F.col("id").alias("component")).limit(0)
            self.labelled = connected_components(self.links, "neardup-labels").withColumnRenamed("node", "id")
        return self.labelled

    def mixed(self, nodes: DataFrame) -> DataFrame:
        """(node, id, n, class, rest, main) of the nodes whose documents are not all of one class yet; ``main`` is
        whether a row is of the node's largest class, ``rest`` counts the others."""
        known = nodes.join(self.labels(), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
        sizes = known.groupBy("node", "class").agg(F.count("*").alias("c"))
        sizes = sizes.groupBy("node").agg((F.sum("c") - F.max("c")).alias("rest"), F.max_by("class", F.struct("c", "class")).alias("largest"))
        return saved(known.join(sizes.where("rest > 0"), "node").withColumn("main", F.col("class") == F.col("largest")).drop("largest"), "neardup-mixed")

    @staticmethod
    def tiles(leaves: DataFrame) -> DataFrame:
        """(tile, id, probe, node, class, main): each node's documents dealt to tiles, and beside them, as probes,
        all that are not of its largest class. Every document meets every probe in one tile."""
        across, down = F.ceil(F.col("n") / TILE), F.ceil(F.col("rest") / PROBES)
        tile = lambda x, y: F.xxhash64("node", x, y)
        all_of = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n)
        base = leaves.select(F.explode(F.transform(all_of(down), lambda y: tile(own(across, 7), y))).alias("tile"), "id", F.lit(False).alias("probe"), "node", "class", "main")
        probes = leaves.where("not main").select(F.explode(F.transform(all_of(across), lambda x: tile(x, own(down, 8)))).alias("tile"), "id", F.lit(True).alias("probe"), "node", "class", "main")
        return base.unionByName(probes)


def _low_bytes(classes: DataFrame) -> DataFrame:
    """(id, sketch): the low byte of each minwise token."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low = (_matrix(batch.column(1)) & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "sketch"])

    return saved(classes.mapInArrow(scan, "id long, sketch binary"), "neardup-sketches")


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable), kept (the id is the component's).

    Two documents are linked if 100 * common >= percent * union of their sets of ``width``-word
    shingles (A-Z lower-cased, words cut at ASCII white space). Defined cases: null or empty
    texts have no shingle, are linked with nothing and kept; each row takes the
    class of its own set, and sets whose least id is the same are one class; a row with a null id takes the component of an equal set, is kept only if there is none, and
    links nothing; the result has as many rows as the input; other columns are not read.
    """
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    join = _Join(source, width, percent)
    found = join.components().select(F.col("id").alias("rep"), "component")
    by_set = join.classes.select("k1", "k2", F.col("id").alias("rep")).join(found, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = join.signed.drop("sig").join(saved(by_set, "neardup-classes-done"), ["k1", "k2"], "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


#: Names of working columns beside those of the documents.
_ID, _TEXT, _NUMBER = "_near_id", "_near_text", "_near_number"


def deduplicated(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every_row: bool = False, **options) -> DataFrame:
    """One document of each class of near-duplicates, with all columns.

    An id with several texts is a document for each of them, so no text goes with another one's copy.
    As it stands, repeated rows of the document that is kept stay, and so do rows with a null id. With
    ``every_row`` exactly one row of each class stays: rows with the same id and text are first
    reduced to one (any of them), and rows with a null id are documents too, behind those with one.
    Rows without words always stay.
    """
    id_, text = F.col(id_col).cast("long"), F.xxhash64(text_col)
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keys = saved(documents.select(id_.alias("id"), text.alias("t"), worded.alias("w")).groupBy("id", "t").agg(F.count("*").alias("c"), F.max("w").alias("w")), "neardup-rows")
    rows = documents.select("*", id_.alias(_ID), text.alias(_TEXT))
    repeated = keys.where("c > 1 and w").select(F.xxhash64("id", "t").alias("id"))
    if every_row and not repeated.isEmpty():
        # reduced before the shuffle, so a row that is repeated very often is no heavier than others
        bits, hashed = id_bits(repeated), rows.withColumn(_NUMBER, F.when(worded, F.xxhash64(_ID, _TEXT)))
        single = sifted(hashed, bits, _NUMBER, "left_anti").unionByName(sifted(hashed, bits, _NUMBER).dropDuplicates([_ID, _TEXT]))
        rows = saved(single.drop(_NUMBER), "neardup-single")
    odd = keys.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias(_ID), F.lit(True).alias("_near_odd"))
    # above any usual id: those stay the least of their class
    own = F.xxhash64(_ID, _TEXT).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    if odd.isEmpty():
        numbered = rows.where(f"{_ID} is not null").withColumn(_NUMBER, F.col(_ID))
    else:
        numbered = rows.where(f"{_ID} is not null").join(odd, _ID, "left").withColumn(_NUMBER, F.when(F.col("_near_odd"), own).otherwise(F.col(_ID)))
    columns = [*rows.columns, _NUMBER]
    none = keys.where("id is null")
    if odd.isEmpty() and none.isEmpty():
        numbered = rows.withColumn(_NUMBER, F.col(_ID))
    else:
        nameless = rows.where(f"{_ID} is null").withColumn(_NUMBER, own if every_row else F.lit(None).cast("long"))
        numbered = saved(numbered.select(columns).unionByName(nameless.select(columns)), "neardup-numbered")
    gone = near_duplicates(numbered, id_col=_NUMBER, text_col=text_col, **options).where("not kept").select(F.col("id").alias(_NUMBER)).distinct()
    return numbered.join(gone, _NUMBER, "left_anti").select(documents.columns)
