"""A Merkle manifest of a dataset as a persistent tree: each changed leaf gives a version that shares all other nodes.

Leaves of a group are ordered and numbered over all tasks. Aligned blocks of BLOCK leaves are hashed up, one block in a
row, and their roots are the leaves of the next, upper tree, level by level, until each group has one node; those of the groups,
ordered, are hashed up likewise to the root. What the upper trees put beside a node is then carried down: every
block gets the siblings between its own root and the dataset's, at most one row for BLOCK nodes.

A version copies the path of its leaf and shares the rest: within the block the ancestors of the leaf are copied, then
those in the upper trees, from the siblings carried down. No version copies a node off its path, and the versions of a block
are made where the block is, so a dataset of any size has no task with all versions. ``version_nodes`` lists the copied nodes: version 0
is the tree without changes, and a node of a version is its copy or else that of version 0.

Defined cases: nodes are hashed in twos, a last one alone; a lone leaf is its group's node, and a lone group's node is the root.
Rows equal in group, order and digest are interchangeable; a group of null comes first; an empty table has no root and no rows.
A leaf whose change is null, or no change, has no version.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.common import numbered, saved

#: Leaves of a block, a power of two.
BLOCK = 1024


def field_text(c: Column) -> Column:
    """A value as its length in bytes, a colon and the value; null as a dash."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*columns: Column) -> Column:
    """Lower-case hex sha256 of the values of a row."""
    return F.sha2(F.concat(*map(field_text, columns)), 256)


def parent(*children: str) -> str:
    return sha256("".join(children).encode()).hexdigest()


class Block:
    """Nodes of an aligned block of at most ``width`` leaves of a tree of ``size`` leaves, level by level."""

    def __init__(self, leaves: list[str], size: int, width: int):
        self.levels = [leaves]
        left = size
        while left > 1 and 1 << len(self.levels) <= width:
            below = self.levels[-1]
            self.levels.append([parent(*below[i : i + 2]) for i in range(0, len(below), 2)])
            left = (left + 1) // 2

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, at: int) -> list[str]:
        """What lies beside the ancestors of a leaf, going up: '<' or '>' and the digest to the left or right, '' if there is none."""
        out = []
        for level in self.levels[:-1]:
            out.append(f"<{level[at - 1]}" if at % 2 else f">{level[at + 1]}" if at + 1 < len(level) else "")
            at //= 2
        return out


def copied(digest: str, path: list[str]) -> list[str]:
    """The nodes of a version: the changed leaf, then a copy of each ancestor up to the root."""
    out = [digest]
    for beside in path:
        own = out[-1]
        out.append(parent(own) if not beside else parent(beside[1:], own) if beside[0] == "<" else parent(own, beside[1:]))
    return out


def _blocks(nodes: DataFrame, width: int, *extra: str) -> DataFrame:
    """(g, block, size, members): aligned blocks of the nodes (g, pos, digest, size and ``extra``), members in order."""
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *extra)))
    return nodes.groupBy("g", F.shiftright("pos", width.bit_length() - 1).alias("block")).agg(F.max("size").alias("size"), members.alias("members"))


def _roots(blocks: DataFrame, width: int) -> DataFrame:
    """The roots of blocks as nodes of the upper tree."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, members = (batch.column(i).to_pylist() for i in (2, 3))
            roots = [Block([m["digest"] for m in own], n, width).root for n, own in zip(sizes, members, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.string()), pa.array([-(-n // width) for n in sizes], pa.int64())], names=["g", "pos", "digest", "size"])

    plain = blocks.select("g", "block", "size", F.transform("members", lambda m: F.struct(m.pos.alias("pos"), m.digest.alias("digest"))).alias("members"))
    return plain.mapInArrow(hashed, "g string, pos long, digest string, size long")


def _raised(blocks: DataFrame, width: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks of all upper trees, lowest first, and (g, digest) of each group's last node."""
    upper = []
    nodes = saved(_roots(blocks, width), f"{name}-roots")
    while (nodes.agg(F.max("size")).first()[0] or 0) > 1:  # a round for each power of the width
        upper.append(saved(_blocks(nodes, width), f"{name}-blocks"))
        nodes = saved(_roots(upper[-1], width), f"{name}-roots")
    return upper, nodes.select("g", "digest")


_ABOVE = "g string, pos long, above array<string>, subroot string, root string"


def _lowered(upper: list[DataFrame], above: DataFrame, width: int) -> DataFrame:
    """(g, pos, above, subroot, root) of the roots of the lowest blocks, from that of each group's last node (pos 0)."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tree = Block([m["digest"] for m in r["members"]], r["size"], width)
                own = [{"g": r["g"], "pos": m["pos"], "above": tree.path(i) + r["above"], "subroot": r["subroot"], "root": r["root"]} for i, m in enumerate(r["members"])]
                columns = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], t) for k, t in zip(own[0], columns, strict=True)], names=list(own[0]))

    for blocks in reversed(upper):
        around = blocks.join(above.withColumnRenamed("pos", "block"), ["g", "block"])
        above = saved(around.mapInArrow(paths, _ABOVE), "merkle-above")
    return above


def manifest(leaves: DataFrame, *, id_col: str, group_col: str, leaf_col: str, changed_col: str | None = None, width: int = BLOCK) -> DataFrame:
    """(id, group, pos, leaf, subroot, root, path, copies, folded) of each row of ``leaves``.

    ``leaf_col``: its digest; ``changed_col``: that of the leaf after a change, or null. Leaves ascend by id in
    each group. ``path``: what lies beside the ancestors, from the leaf to the root ('<' left, '>' right, '' nothing).
    ``copies``: the nodes that a changed leaf's version copies, itself first; null without a change. ``folded``: the root
    worked out from the changed, else the own leaf and the path. ``width``: leaves of a block, a power of two.
    """
    schema = {c: leaves.schema[c].dataType.simpleString() for c in (id_col, group_col)}
    key = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))  # null first, then bytewise
    changed = F.col(changed_col) if changed_col else F.lit(None)
    rows = leaves.select(key.alias("g"), F.col(id_col).alias("id"), F.col(leaf_col).alias("digest"), changed.cast("string").alias("changed"))
    rows = numbered(saved(rows, "merkle-leaves"), "g", ["id", "digest", "changed"], "merkle-sorted")
    lowest = saved(_blocks(rows.select("g", F.col("_pos").alias("pos"), F.col("_size").alias("size"), "digest", "id", "changed"), width, "id", "changed"), "merkle-blocks")
    upper, subroots = _raised(lowest, width, "merkle")
    # the groups' nodes are the leaves of one tree more
    groups = numbered(subroots.withColumn("all", F.lit("")), "all", ["g"], "merkle-groups")
    tops = saved(_blocks(groups.select(F.col("all").alias("g"), F.col("_pos").alias("pos"), F.col("_size").alias("size"), "digest", F.col("g").alias("of")), width, "of"), "merkle-tops")
    over, root = _raised(tops, width, "merkle-top")
    start = root.select("g", F.lit(0).cast("long").alias("pos"), F.expr("cast(array() as array<string>)").alias("above"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    named = tops.select(F.explode("members").alias("m")).select("m.pos", "m.of", F.col("m.digest").alias("own"))
    by_group = _lowered([tops, *over], start, width).join(named, "pos").select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "above", F.col("own").alias("subroot"), "root")
    above = _lowered(upper, saved(by_group, "merkle-by-group"), width)
    kind = schema[id_col]
    out = f"id {kind}, g string, pos long, leaf string, subroot string, root string, path array<string>, copies array<string>, folded string"

    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                g, size, above, subroot, root = (batch.column(k)[i].as_py() for k in ("g", "size", "above", "subroot", "root"))
                members = batch.column("members")[i].values
                leaves, changed = members.field("digest").to_pylist(), members.field("changed").to_pylist()
                tree = Block(leaves, size, width)
                paths = [tree.path(k) + above for k in range(len(leaves))]
                copies = [copied(new or old, path) for old, new, path in zip(leaves, changed, paths, strict=True)]
                n = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [
                        members.field("id"), pa.array([g] * n, pa.string()), members.field("pos"), members.field("digest"), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()),
                        pa.array(paths, strings), pa.array([c if new is not None else None for c, new in zip(copies, changed, strict=True)], strings), pa.array([c[-1] for c in copies], pa.string()),
                    ],
                    names=["id", "g", "pos", "leaf", "subroot", "root", "path", "copies", "folded"],
                )

    around = lowest.join(above.withColumnRenamed("pos", "block"), ["g", "block"])
    found = around.mapInArrow(versions, out)
    group = F.when(F.col("g") != "0", F.substring("g", 2, 1 << 30)).cast(schema[group_col])
    return found.select("id", group.alias("group"), "pos", "leaf", "subroot", "root", "path", "copies", "folded")


def siblings(path: str = "path") -> Column:
    """The digests beside the ancestors, from the leaf to the root: the proof of a leaf."""
    return F.transform(F.filter(path, lambda x: x != ""), lambda x: F.substring(x, 2, 64))


def version_nodes(found: DataFrame) -> DataFrame:
    """(id, group, level, digest): the nodes that each changed leaf's version copies, with the height above the leaf; all others are those of the
    tree without changes."""
    return found.where("copies is not null").select("id", "group", F.posexplode("copies").alias("level", "digest"))
