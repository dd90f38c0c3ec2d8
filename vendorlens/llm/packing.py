"""Packing token ids into sequences: first-fit decreasing with a tournament tree of bin capacities.

Pieces of documents are dealt to groups at random (a seeded hash of a piece's document, place, ids and, among equal
pieces of a task, number), each group packed by itself; groups are as even as the hash and go to tasks in turn.
A document is cut into full sequences and a rest; the pieces of a group come in descending
length and each goes to the first bin with room, found by walking down a tournament tree whose
inner nodes hold the largest room below. Full pieces fill a bin each. A piece's place is final
when it arrives, so a task holds bins, not ids, and its memory doesn't depend on the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.common import partitions_for
from vendorlens.llm.tokens import binaries, encoded

LENGTH = 2048
#: Documents and bytes of text of a group, on average, at most. Each group leaves a few bins with room.
GROUP_DOCUMENTS, GROUP_BYTES = 8192, 4 << 20
#: Sequence ids of a group start at group * GROUP_SPAN.
GROUP_SPAN = 1 << 40

PIECES = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Room of bins in order; the first bin with enough room in time log(bins)."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.bins = capacity, 1, 0
        self.room = [0, 0]

    def _grow(self) -> None:
        n = self.leaves
        room = [0] * (4 * n)
        room[2 * n : 3 * n] = self.room[n:]
        for i in range(2 * n - 1, 0, -1):
            room[i] = max(room[2 * i], room[2 * i + 1])
        self.leaves, self.room = 2 * n, room

    def _set(self, leaf: int, room: int) -> None:
        at = leaf + self.leaves
        self.room[at] = room
        while at > 1:
            at //= 2
            top = max(self.room[2 * at], self.room[2 * at + 1])
            if self.room[at] == top:
                break
            self.room[at] = top

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece; a new bin if none has room."""
        if self.room[1] < size:
            if self.bins == self.leaves:
                self._grow()
            leaf, self.bins = self.bins, self.bins + 1
            self._set(leaf, self.capacity - size)
            return leaf, 0
        at = 1
        while at < self.leaves:
            at *= 2
            if self.room[at] < size:
                at += 1
        leaf, room = at - self.leaves, self.room[at]
        self._set(leaf, room - size)
        return leaf, self.capacity - room


def _cut(path: str, end_id: int, length: int):
    """(id, start, length, ids, doc_tokens, copy) of the pieces of rows (id, text); ``copy`` numbers equal pieces of a task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            owners = batch.column(0).to_pylist()
            for lo, hi, ids, offsets in encoded(batch.column(1), path, end_id):
                n = np.diff(offsets)
                pieces = -(-n // length)
                doc = np.repeat(np.arange(hi - lo), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                size = np.minimum(length, n[doc] - start)
                cuts = np.append(offsets[:-1][doc] + start, offsets[-1])
                own, copy = binaries(ids, cuts), []
                for d, at, x in zip(doc.tolist(), start.tolist(), own, strict=True):
                    key = hash((owners[lo + d], at, zlib.crc32(x.as_buffer())))
                    copy.append(seen.get(key, 0))
                    seen[key] = copy[-1] + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + lo)), pa.array(start), pa.array(size), own, pa.array(n[doc]), pa.array(copy, pa.int64())], names=["id", "start", "length", "ids", "doc_tokens", "copy"])

    return scan


def _packed(length: int):
    """Adds sequence and offset. Rows: group, id, start, length, ids, doc_tokens, by group and descending length."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree, full = None, None, 0
        for batch in batches:
            sequence, offset = [], []
            for g, n in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if g != group:
                    group, tree, full = g, TournamentTree(length), 0
                if n == length:
                    place, at = 2 * full, 0  # even: full sequences, odd: bins
                    full += 1
                else:
                    leaf, at = tree.place(n)
                    place = 2 * leaf + 1
                sequence.append(g * GROUP_SPAN + place)
                offset.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return scan


def packed(documents: DataFrame, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_documents: int = GROUP_DOCUMENTS, group_bytes: int = GROUP_BYTES, seed: int = 17) -> DataFrame:
    """The pieces of all documents (PIECES): which ids of which document lie where in which sequence.

    ``ids`` are little-endian 32-bit integers. Defined cases: a null or empty text is a piece
    with the end id alone; a null id is packed like any other; rows that share an id are packed
    each by itself, and rows that are equal are spread like others; no documents, no sequences; other columns are not read.
    """
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = source.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-size.rows // group_documents), -(-size.bytes // group_bytes))
    pieces = source.mapInArrow(_cut(tokenizer_path, end_id, length), "id long, start long, length long, ids binary, doc_tokens long, copy long")
    # each piece goes to a group by itself, so a very long document is spread over all groups
    group = F.pmod(F.xxhash64(F.lit(seed), "id", "start", "ids", "copy"), F.lit(groups))
    dealt = pieces.select(group.alias("group"), "id", "start", "length", "ids", "doc_tokens").repartitionById(min(groups, partitions_for(documents)), F.col("group").cast("int"))
    return dealt.sortWithinPartitions("group", F.desc("length"), "id", "start").mapInArrow(_packed(length), PIECES)
