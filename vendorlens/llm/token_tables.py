"""Token ids in sorted-string-table shards: write, read back, and look up documents.

A shard has the documents of one range of ids in ascending order:

    blocks      entries (shared, rest of the key, key suffix, value), compressed by zlib
    index       for each block: its first and last key and its number of ids
    filter      a Bloom filter of all keys
    footer      40 bytes: place of index and filter, entries, ids, magic

A key is the document's number as 20 digits (sign and 19), so keys sort as the numbers do, and
each key holds only what differs from the one before. A value is the number of ids and the ids
as little-endian integers, 16 bits wide where the block's ids allow it. A lookup reads the
tails (index, filter, footer) of the shards in range, asks the filter, searches the index by halves and reads one block.

Spark writes the shards: the documents are range-partitioned by id, and each task puts its shards, one after the
other, into a file of the shared folder, a record for each block and one for the tail. The file is Parquet as a container,
so any store that Spark writes to will do and a lost task is simply run again; its pages are a few records
long, so that a filter on shard and block skips the bytes of all other blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendorlens.llm.common import partitions_for, saved
from vendorlens.llm.tokens import binaries, encoded

#: Uncompressed bytes of a block, and ids of a shard; a longer document is a block of its own.
BLOCK_BYTES = 256 << 10
SHARD_IDS = 4_000_000
BITS_PER_KEY = 10
HASHES = 7
MAGIC = b"TOKSST02"
FOOTER = struct.Struct("<QQQQ8s")
ENTRY = struct.Struct("<20s20sQ")

#: A record of a shard: a block, or (block -1) the tail. ``before``: ids of the shard's earlier blocks.
RECORDS = "shard long, block int, first_id long, last_id long, n_docs long, n_ids long, before long, data binary"
#: Records of a page of the container, and bytes of its row groups.
PAGES = {"parquet.page.row.count.limit": "2", "parquet.page.size": "262144", "parquet.block.size": str(16 << 20), "compression": "none"}


def key_of(doc_id: int) -> bytes:
    """20 bytes that sort as the number does."""
    return b"%d%019d" % ((1, doc_id) if doc_id >= 0 else (0, doc_id + (1 << 63)))


def id_of(key: bytes) -> int:
    return int(key[1:]) - (0 if key[:1] == b"1" else 1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def _bits(key: bytes, size: int) -> Iterator[int]:
    a, b = zlib.crc32(key), zlib.adler32(key) * 2654435761 & 0xFFFFFFFF | 1
    return ((a + i * b) % size for i in range(HASHES))


class ShardWriter:
    """Builds one shard, block by block."""

    def __init__(self):
        self.index: list[tuple[bytes, bytes, int]] = []
        self.keys: list[bytes] = []
        self.block: list[tuple[bytes, np.ndarray]] = []
        self.size = self.ids = 0

    def add(self, doc_id: int, ids: np.ndarray) -> dict | None:
        """Keys must not descend; equal keys stay in the order they came. Returns the block before, if it is full."""
        full = self.flush() if self.size and self.size + 4 * len(ids) > BLOCK_BYTES else None
        self.block.append((key_of(doc_id), ids))
        self.size += 4 * len(ids) + 24
        return full

    def flush(self) -> dict | None:
        """The record of the open block."""
        if not self.block:
            return None
        wide = max((int(x.max()) for _, x in self.block if len(x)), default=0) > 0xFFFF
        raw, last, n = bytearray([wide]), b"", 0
        for key, ids in self.block:
            same = next((i for i, (a, b) in enumerate(zip(key, last)) if a != b), min(len(key), len(last)))
            raw += varint(same) + varint(len(key) - same) + key[same:] + varint(len(ids)) + ids.astype("<u4" if wide else "<u2").tobytes()
            last, n = key, n + len(ids)
            self.keys.append(key)
        first = self.block[0][0]
        out = {"block": len(self.index), "first_id": id_of(first), "last_id": id_of(last), "n_docs": len(self.block), "n_ids": n, "before": self.ids, "data": zlib.compress(bytes(raw), 1)}
        self.index.append((first, last, n))
        self.ids += n
        self.block, self.size = [], 0
        return out

    def tail(self) -> dict | None:
        """The record of index, filter and footer, after the last flush; None for a shard without documents."""
        if not self.index:
            return None
        index = b"".join(ENTRY.pack(*x) for x in self.index)
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for b in _bits(key, bits):
                bloom[b >> 3] |= 1 << (b & 7)
        data = index + struct.pack("<Q", bits) + bytes(bloom) + FOOTER.pack(0, len(index), len(self.keys), self.ids, MAGIC)
        return {"block": -1, "first_id": id_of(self.index[0][0]), "last_id": id_of(self.index[-1][1]), "n_docs": len(self.keys), "n_ids": self.ids, "before": 0, "data": data}


class Tail:
    """A shard's index and filter as they are read back."""

    def __init__(self, data: bytes):
        self.data = data
        self.at, self.filter, self.entries, self.ids, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not the tail of a token shard")
        self.blocks = (self.filter - self.at) // ENTRY.size
        self.bits = struct.unpack_from("<Q", data, self.filter)[0]

    def may_hold(self, doc_id: int) -> bool:
        bloom = self.filter + 8
        return all(self.data[bloom + (b >> 3)] >> (b & 7) & 1 for b in _bits(key_of(doc_id), self.bits))

    def block_of(self, doc_id: int) -> int | None:
        """The only block that can hold a document (the first, if rows that share its id fill several)."""
        if not self.may_hold(doc_id):
            return None
        key, lo, hi = key_of(doc_id), 0, self.blocks
        while lo < hi:  # the first block whose last key is not below
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ENTRY.unpack_from(self.data, self.at + ENTRY.size * mid)[1] < key else (lo, mid)
        return lo if lo < self.blocks and ENTRY.unpack_from(self.data, self.at + ENTRY.size * lo)[0] <= key else None


def entries(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of a block, in order."""
    raw = zlib.decompress(data)
    width, last, at = (4, b"", 1) if raw[0] else (2, b"", 1)
    while at < len(raw):
        same, at = read_varint(raw, at)
        rest, at = read_varint(raw, at)
        last = last[:same] + raw[at : at + rest]
        count, at = read_varint(raw, at + rest)
        yield id_of(last), np.frombuffer(raw, f"<u{width}", count, at).astype("<u4")
        at += width * count


_RECORD = pa.schema([("shard", pa.int64()), ("block", pa.int32()), *((n, pa.int64()) for n in ("first_id", "last_id", "n_docs", "n_ids", "before")), ("data", pa.binary())])


def _written(path: str, end_id: int):
    """The records of a task's shards. Rows (id, text) in order of id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, ShardWriter()
        record = lambda x: pa.RecordBatch.from_pylist([{"shard": number} | x], schema=_RECORD)

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for lo, hi, ids, offsets in encoded(batch.column(1), path, end_id):
                for i in range(lo, hi):
                    if shard.ids >= SHARD_IDS:
                        yield from (record(x) for x in (shard.flush(), shard.tail()) if x)
                        number, shard = number + 1, ShardWriter()
                    if full := shard.add(docs[i], ids[offsets[i - lo] : offsets[i - lo + 1]]):
                        yield record(full)
        yield from (record(x) for x in (shard.flush(), shard.tail()) if x)

    return scan


def write_tables(documents: DataFrame, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards of all documents and return their records (RECORDS) as they are read back. Order of shards, of blocks
    in them and of documents in these: ascending id.

    Defined cases: a null or empty text has only the end id; rows that share an id follow each
    other by their text; rows with a null id have no key and are left out; no documents, no shard.
    """
    source = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the text's hash lets the ranges split an id that very many rows share
    ordered = source.repartitionByRange(partitions_for(documents, 24), "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    return saved(ordered.mapInArrow(_written(tokenizer_path, end_id), RECORDS), "token-shards", **PAGES)


def read_tables(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the shards; start counts the ids of all before it,
    ids are little-endian 32-bit integers."""
    # shards are few (one for SHARD_IDS ids), and a block knows its place in its shard
    before = _running(shards.where("block = -1").select("shard", "n_ids"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, ids = zip(*entries(data), strict=True)
                offsets = np.cumsum([0, *map(len, ids)])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), binaries(np.concatenate(ids), offsets)], names=["doc_id", "start", "n_tokens", "ids"])

    joined = shards.where("block >= 0").join(before, "shard").select((F.col("start") + F.col("before")).alias("start"), "data")
    return joined.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids binary")


def _running(keys: DataFrame) -> DataFrame:
    """The ids before each shard, from sums per range of shards and sums within a range."""
    parts = keys.repartitionByRange(8, "shard").withColumn("part", F.spark_partition_id())
    parts = saved(parts, "token-shard-keys")
    total = parts.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = total.alias("a").join(total.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(earlier, "part").select("shard", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start"))


#: Blocks that a lookup asks for one by one; with more of them, the nearest are asked for together, with what lies between.
ASKED_RANGES = 512


def block_filter(places: Sequence[tuple[int, int]]) -> Column:
    """Which records are the blocks (shard, block), as a filter that Parquet's pages can be chosen by."""
    asked = sorted(set(places))
    ranges = [[s, b, b] for s, b in asked]
    if len(ranges) > ASKED_RANGES:
        gaps = sorted(b[1] - a[2] for a, b in zip(ranges, ranges[1:], strict=False) if a[0] == b[0])
        wide = gaps[min(len(ranges) - ASKED_RANGES, len(gaps)) - 1] if gaps else 0
        merged: list[list[int]] = []
        for s, lo, hi in ranges:
            if merged and merged[-1][0] == s and lo - merged[-1][2] <= wide:
                merged[-1][2] = hi
            else:
                merged.append([s, lo, hi])
        ranges = merged
    if not ranges:
        return F.lit(False)
    parts = [(F.col("shard") == s) & (F.col("block") == lo if lo == hi else F.col("block").between(lo, hi)) for s, lo, hi in ranges]
    while len(parts) > 1:  # pairwise, so that the expression stays shallow
        parts = [parts[i] | parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def lookup(shards: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids as an array) of the asked documents, once for each id: the tails of the shards in range say which blocks
    can hold them, and only those are read (of more than ASKED_RANGES blocks, those between the nearest ones too)."""
    wanted = np.unique(np.array(list(doc_ids), np.int64))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for number, first, last, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, tail = wanted[np.searchsorted(wanted, first) : np.searchsorted(wanted, last, "right")].tolist(), Tail(data)
                found += [{"shard": number, "block": b, "doc_id": d} for d in own if (b := tail.block_of(d)) is not None]
            yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("shard", pa.int64()), ("block", pa.int32()), ("doc_id", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: dict[int, np.ndarray] = {}
                for doc, ids in entries(data):
                    if doc in asked:
                        held.setdefault(doc, ids)
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    near = shards.where("block = -1")
    if len(wanted):
        near = near.where((F.col("first_id") <= int(wanted[-1])) & (F.col("last_id") >= int(wanted[0])))
    places = saved(near.select("shard", "first_id", "last_id", "data").mapInArrow(tails, "shard long, block int, doc_id long"), "token-places")
    # rows that share an id may fill the end of one shard and the start of others: the first is meant
    first = places.groupBy("doc_id").agg(F.min(F.struct("shard", "block")).alias("x")).select("doc_id", "x.shard", "x.block")
    asked = first.groupBy("shard", "block").agg(F.collect_list("doc_id").alias("asked"))
    places = [(r.shard, r.block) for r in asked.select("shard", "block").collect()]  # at most as many as were asked for
    return shards.where(block_filter(places)).join(asked, ["shard", "block"]).select("asked", "data").mapInArrow(read, "doc_id long, ids array<long>")
