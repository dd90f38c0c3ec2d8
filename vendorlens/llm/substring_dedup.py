"""Duplicate passages by relative Lempel-Ziv parsing against reference blocks of earlier documents.

First it is found out which documents are references. An anchor is the least hash among the
SEED-word runs of a window of ``width`` words; equal windows have equal anchors, so only
windows whose anchor is also in another document can repeat. Those windows are fingerprinted
(from 64-bit hashes of words) and each points to the first document that has it: a route from
a document to a reference.

References are put together in blocks of about BLOCK_WORDS words. A task indexes a block: all its suffixes of
``width`` words or more, in order of the hash of their first ``width`` words, then of document and place. It parses
every document with a route to the block: at the first place whose next ``width`` words start a suffix of
a smaller document, the longest match with any such suffix is a factor, compared word by word (as 64-bit hashes);
the parse goes on ``width - 1`` words before the factor's end, so that windows across the boundary
are looked up too and no repeat is lost where the reference changes. The factors of a document from all
blocks are its duplicate spans, each with its reference and place there. A block that very many documents have a route to is
handed to several tasks, each with a part of them.

Exact copies of a whole document are found by a hash of all its words and never enter the index.

Defined cases: null or empty texts have no words; documents of fewer than ``width`` words lose
nothing; the document with the least id keeps a passage, and a repeat inside one document
alone stays; rows that share an id don't remove anything from each other, and each is parsed by its own text; rows with a null id
are neither references nor cut; one row for each input row, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.common import id_bits, partitions_for, saved, sifted
from vendorlens.llm.words import blocks, mix, powers, windows

#: Words in a run that can be an anchor.
SEED = 20

#: Words of a reference block, on average (a longer document is in it as a whole), and documents that one task parses against it.
BLOCK_WORDS = 150_000
PARSED_DOCUMENTS = 512
#: Suffixes that are compared with a document one after the other.
FEW = 16

FACTORS = "array<struct<start:int,stop:int,reference:long,place:int>>"


def window_anchors(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, anchor and fingerprint of every window of a block."""
    seed = min(SEED, max(1, width // 2))
    start, seeds = windows(h, first, seed)
    least = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
    least[start] = seeds
    span, k = width - seed + 1, 1
    while k < span:  # the minimum over k runs, then over more
        step = min(k, span - k)
        if step >= len(least):
            break
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        k += step
    start, print_ = windows(h, first, width)
    return start, least[start], print_


def _first_scan(width: int):
    """id, t, n_words, sha of the words, hash of all words (null if there are too few), distinct anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for block in blocks(texts, "space", False):
                h = block.hashes()
                start, anchor, _ = window_anchors(h, block.first, width)
                cut = np.searchsorted(start, block.first)
                own = texts.slice(block.lo, block.hi - block.lo).to_pylist()
                sha = [hashlib.sha256(b" ".join((t or "").encode().split())).digest() for t in own]
                c1, c2, anchors = [], [], []
                for i in range(block.hi - block.lo):
                    lo, hi = block.first[i], block.first[i + 1]
                    if hi - lo < width:
                        c1.append(None)
                        c2.append(None)
                        anchors.append(None)
                        continue
                    place = np.arange(hi - lo, dtype=np.uint64)
                    c1.append(int(mix(h[lo:hi] + mix(place)).sum(dtype=np.uint64).view(np.int64)))
                    c2.append(int(mix(h[lo:hi] ^ mix(place + np.uint64(1 << 40))).sum(dtype=np.uint64).view(np.int64)))
                    anchors.append(np.unique(anchor[cut[i] : cut[i + 1]]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(block.lo, block.hi - block.lo) for k in (0, 2)), pa.array(np.diff(block.first)), pa.array(sha, pa.binary()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(anchors, pa.binary())],
                    names=["id", "t", "n_words", "sha", "c1", "c2", "anchors"],
                )

    return scan


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id) of rows (id, anchors)."""
    for batch in batches:
        packed = batch.column(1).to_pylist()
        flat = np.frombuffer(b"".join(packed), np.int64)
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(packed)), [len(x) // 8 for x in packed])))
        yield pa.RecordBatch.from_arrays([pa.array(flat), ids], names=["anchor", "id"])


def _fingerprints(width: int):
    """(w1, w2, id): the distinct windows of each document that have a shared anchor. Rows: id, text, anchors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(2).to_pylist()
            for block in blocks(batch.column(1), "space", False):
                h = block.hashes()
                start, anchor, w1 = window_anchors(h, block.first, width)
                _, w2 = windows(mix(h ^ np.uint64(0x5DEECE66D1CE4E5B)), block.first, width)
                cut = np.searchsorted(start, block.first)
                one, two, rows = [], [], []
                for i in range(block.hi - block.lo):
                    known = np.isin(anchor[cut[i] : cut[i + 1]].view(np.int64), np.array(shared[block.lo + i], np.int64))
                    a, at = np.unique(w1[cut[i] : cut[i + 1]][known], return_index=True)
                    one.append(a)
                    two.append(w2[cut[i] : cut[i + 1]][known][at])
                    rows.append(np.full(len(a), block.lo + i))
                if one:
                    ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)), ids], names=["w1", "w2", "id"])

    return scan


class ReferenceBlock:
    """An index of all suffixes of ``width`` words or more of some documents."""

    def __init__(self, ids: list[int], texts: list[str | None], width: int):
        self.width = width
        words, starts, prints, first, at = [], [], [], [0], 0
        for block in blocks(pa.array(texts, pa.string()), "space", False):
            h = block.hashes()
            start, own = windows(h, block.first, width)
            words.append(h)
            starts.append(start + at)
            prints.append(own)
            first += (block.first[1:] + at).tolist()
            at += len(h)
        self.words = np.concatenate([*words, np.empty(0, np.uint64)])
        starts, prints = np.concatenate([*starts, np.empty(0, np.int64)]), np.concatenate([*prints, np.empty(0, np.uint64)])
        self.first, ids = np.array(first), np.array(ids, np.int64)
        owner = np.searchsorted(self.first, starts, "right") - 1
        order = np.lexsort((starts, ids[owner], prints))
        self.prints, self.starts, self.owner = prints[order], starts[order], owner[order]
        self.ids = ids

    @cached_property
    def up(self) -> np.ndarray:
        return powers(len(self.words) + 1)[0]

    @cached_property
    def down(self) -> np.ndarray:
        return powers(len(self.words) + 1)[1]

    @cached_property
    def sums(self) -> np.ndarray:
        """Sums of the words before each place, each times its place's power."""
        return np.concatenate([[np.uint64(0)], np.cumsum(self.words * self.up[:-1])])

    def parsed(self, doc_id: int, h: np.ndarray, start: np.ndarray, own: np.ndarray) -> list[dict]:
        """The factors of a document: hashes of its words, starts and hashes of its windows."""
        lo = np.searchsorted(self.prints, own, "left")
        # the least document comes first: without a smaller one there nothing can be copied from the block
        known = lo < len(self.prints)
        known[known] = (self.prints[lo[known]] == own[known]) & (self.ids[self.owner[lo[known]]] < doc_id)
        at, lo = start[known], lo[known]
        hi = np.searchsorted(self.prints, own[known], "right")
        out, k = [], 0
        while k < len(at):
            s = int(at[k])
            span = slice(int(lo[k]), int(hi[k]))
            place, n = self.longest(h[s:], self.starts[span], self.owner[span], doc_id)
            if n >= self.width:
                doc = int(np.searchsorted(self.first, place, "right") - 1)
                out.append({"start": s, "stop": s + n, "reference": int(self.ids[doc]), "place": int(place - self.first[doc])})
                k = max(k + 1, int(np.searchsorted(at, s + n - self.width + 1)))
            else:
                k += 1
        return out

    def longest(self, rest: np.ndarray, places: np.ndarray, owner: np.ndarray, doc_id: int) -> tuple[int, int]:
        """(place, words) of the longest match of ``rest`` with suffixes of smaller documents; the first of equally long ones."""
        own = self.ids[owner] < doc_id
        places, room = places[own], np.minimum(self.first[owner[own] + 1] - places[own], len(rest))
        if len(places) > FEW:
            # by halves, from hashes of stretches; the words themselves have the last word below
            sums, more = self.sums, np.concatenate([[np.uint64(0)], np.cumsum(rest[: room.max()] * self.up[: room.max()])])
            low, high = np.full(len(places), self.width - 1), room.copy()
            while (go := low < high).any():
                mid = (low + high + 1) >> 1
                same = (sums[places + mid] - sums[places]) * self.down[places] == more[mid]
                low, high = np.where(go & same, mid, low), np.where(go & ~same, mid - 1, high)
            top = int(low.argmax())
            places, room = places[top : top + 1], room[top : top + 1]
        best = (0, 0)
        for place, n in zip(places.tolist(), room.tolist(), strict=True):
            differ = np.flatnonzero(self.words[place : place + n] != rest[:n])
            if (length := int(differ[0]) if len(differ) else n) > best[1]:
                best = (place, length)
        return best


def _factored(width: int):
    """(id, t, factors) of documents with a factor. Rows: block, salt, id, t, document, text, by the first two, references first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index, refs = None, None, ([], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _heads(batch, (0, 1, 4))  # parts of one block and of one kind
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                own = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                if own != key:
                    key, index, refs = own, None, ([], [])
                if not part.column(4)[0].as_py():
                    refs[0].extend(part.column(2).to_pylist())
                    refs[1].extend(part.column(5).to_pylist())
                    continue
                if index is None:
                    index, refs = ReferenceBlock(*refs, width), ([], [])
                ids, marks = part.column(2).to_pylist(), part.column(3).to_pylist()
                for block in blocks(part.column(5), "space", False):
                    h = block.hashes()
                    start, w = windows(h, block.first, width)
                    at = np.searchsorted(start, block.first)
                    found = []
                    for i in range(block.hi - block.lo):
                        a, n = block.first[i], block.lo + i
                        got = index.parsed(ids[n], h[a : block.first[i + 1]], start[at[i] : at[i + 1]] - a, w[at[i] : at[i + 1]])
                        if got:
                            found.append({"id": ids[n], "t": marks[n], "factors": got})
                    yield pa.RecordBatch.from_pylist(found, schema=_FOUND)

    return scan


def _heads(batch: pa.RecordBatch, keys: tuple[int, ...]) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    new = np.zeros(batch.num_rows + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def kept_words(n: int, spans: list[dict]) -> np.ndarray:
    """Which of n words no span covers."""
    change = np.zeros(n + 1, np.int64)
    for s in spans:
        change[s["start"]] += 1
        change[s["stop"]] -= 1
    return np.cumsum(change[:-1]) == 0


_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("reference", pa.int64()), ("place", pa.int32())]))
_FOUND = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("factors", _FACTORS)])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, t, n_removed, kept text, factors. Rows: id, t, text, factors."""
    for batch in batches:
        for block in blocks(batch.column(2), "space", False):
            own = batch.slice(block.lo, block.hi - block.lo)
            removed, texts = [], []
            for i, spans in enumerate(own.column(3).to_pylist()):
                a = int(block.first[i])
                n = int(block.first[i + 1]) - a
                keep = kept_words(n, spans)
                removed.append(int(n - keep.sum()))
                texts.append(b" ".join(block.word(int(k) + a) for k in np.flatnonzero(keep)).decode())
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), own.column(3)], names=["id", "t", "n_removed", "kept_text", "factors"])


def routed(source: DataFrame, routes: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """(id, t, factors) of the documents (id, t, text) parsed against the blocks of their references (id, reference).

    ``sizes``: id and n_words of the references.
    """
    words = sizes.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64("reference"), F.lit(max(1, -(-words // BLOCK_WORDS))))
    asked = saved(routes.select("id", block.alias("block")).distinct(), "substring-asked")
    salts = asked.groupBy("block").agg(F.ceil(F.count("*") / PARSED_DOCUMENTS).alias("salts"))
    references = routes.select("reference").distinct().withColumn("block", block).join(salts, "block")
    references = saved(references.select(F.col("reference").alias("id"), "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")), "substring-references")
    documents = asked.join(salts, "block").select("id", "block", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"))
    rows = lambda ids, document: sifted(source, id_bits(ids)).join(ids, "id").select("block", "salt", "id", "t", F.lit(document).alias("document"), "text")
    both = rows(references, False).unionByName(rows(saved(documents, "substring-documents"), True))
    return both.repartition(partitions_for(source), "block", "salt").sortWithinPartitions("block", "salt", "document", "id").mapInArrow(_factored(width), f"id long, t long, factors {FACTORS}")


def repeated_passages(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> tuple[DataFrame, DataFrame]:
    """(summary, cut): ``summary`` has a row for each input row: id, t (the text's hash), n_words, sha (of all words) and ``first``,
    the least id with the same words (null if the row is that, or is shorter than a window). ``cut`` has, for each
    other document with a repeat, once for each id and t: id, t, n_removed, kept_text and factors (FACTORS)."""
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    scanned = saved(source.mapInArrow(_first_scan(width), "id long, t long, n_words long, sha binary, c1 long, c2 long, anchors binary"), "substring-scan")
    whole = scanned.where("c1 is not null and id is not null")
    firsts = whole.groupBy("c1", "c2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    copied = saved(firsts.where("last > first").drop("last"), "substring-copies")
    summary = saved(
        scanned.drop("anchors").join(copied, ["c1", "c2"], "left").select("id", "t", "n_words", "sha", F.when(F.col("first") < F.col("id"), F.col("first")).alias("first")),
        "substring-summary",
    )
    index = whole.join(copied, ["c1", "c2"], "left").where("first is null or first = id").select("id", "anchors")
    index = saved(index.mapInArrow(_exploded, "anchor long, id long"), "substring-index")
    shared = index.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    wanted = saved(index.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "substring-anchors")

    near = sifted(source, id_bits(wanted)).join(wanted, "id")
    prints = saved(near.select("id", "text", "anchors").mapInArrow(_fingerprints(width), "w1 long, w2 long, id long"), "substring-windows")
    references = prints.groupBy("w1", "w2").agg(F.min("id").alias("reference"), F.max("id").alias("hi")).where("reference < hi").drop("hi")
    routes = saved(prints.join(references, ["w1", "w2"]).where("reference < id").select("id", "reference").distinct(), "substring-routes")
    sizes = scanned.select("id", "n_words").join(routes.select(F.col("reference").alias("id")).distinct(), "id", "left_semi")
    found = saved(routed(source, routes, sizes, width), "substring-factors")
    spans = saved(found.groupBy("id", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("factors")))).alias("factors")), "substring-spans")
    rows = sifted(source, id_bits(spans)).join(spans, ["id", "t"]).dropDuplicates(["id", "t"])
    return summary, rows.select("id", "t", "text", "factors").mapInArrow(_cut, f"id long, t long, n_removed long, kept_text string, factors {FACTORS}")


#: Name of a working column beside those of the documents.
_MARK = "_substring_text"


def without_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """The documents with their repeated passages taken out of the text; all columns stay.

    A text that loses nothing stays as it is; in others the kept words are joined by one space;
    a copy of an earlier document becomes empty.
    """
    summary, cut = repeated_passages(documents, id_col=id_col, text_col=text_col, width=width)
    gone = summary.where("first is not null").select("id", "t", F.lit("").alias("kept_text")).distinct()
    change = cut.select("id", "t", "kept_text").join(gone, ["id", "t"], "left_anti").unionByName(gone)
    joined = documents.withColumn(_MARK, F.xxhash64(text_col)).alias("d").join(change.alias("c"), (F.col(f"d.`{id_col}`").cast("long") == F.col("c.id")) & (F.col(f"d.{_MARK}") == F.col("c.t")), "left")
    own = lambda c: F.col(f"d.`{c}`")
    return joined.select(*[F.coalesce(F.col("c.kept_text"), own(c)).alias(c) if c == text_col else own(c) for c in documents.columns])
