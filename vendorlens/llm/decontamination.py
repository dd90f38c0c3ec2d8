"""Benchmark decontamination with suffix arrays of the training documents.

Each shard (a block of whole documents) gets a suffix array over its words. Every suffix of
the benchmark that can match a window in a shard is binary-searched there, one word deeper at a time, which gives the
longest verbatim match and all places of each window. Which suffixes can is told by the hashes of their windows, looked up in the
sorted hashes of the benchmark's windows for each window of the shard: the work for a shard grows with its own words and
matches, not with the benchmark. Shards need nothing from each other,
so there is no shuffle and a hot source or passage only adds work where its rows are.

Defined cases: a null or empty text has no words and is clean; an item without words has no
window; an item shorter than the window is one window; repeated rows are judged each by
itself; items with a null id mark words but are not listed; an empty benchmark marks
nothing; columns of the documents are kept, none of them is read but id and text. Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.common import saved
from vendorlens.llm.words import Block, blocks, windows

#: Benchmark text sent to the executors at once; a larger benchmark takes several passes.
BENCHMARK_BLOCK_BYTES = 8 << 20

MATCHES = (
    "id {id}, n_words long, n_hit long, spans array<struct<start:int,stop:int>>, "
    "items array<struct<item_id:string,longest:int,item_word:int,doc_word:int>>"
)


@dataclass
class Suffixes:
    """All suffixes of the items of one benchmark block, as ranks in its vocabulary."""

    vocabulary: np.ndarray  # sorted word hashes; rank r + 1 is word r, rank 0 any other
    ranks: np.ndarray  # all items' words, a 0 after each item
    start: np.ndarray  # of each suffix in ranks
    left: np.ndarray  # words to the item's end
    full: np.ndarray  # words of the item
    item: np.ndarray  # item of each suffix
    need: np.ndarray  # match length from which it is a window; 0: no window starts here
    ids: list[str | None]
    starts: dict[int, tuple[np.ndarray, np.ndarray]]  # of each length of windows: their hashes, sorted, and the suffixes that they start

    @classmethod
    def of(cls, ids: list[str | None], texts: list[str | None], width: int) -> Suffixes:
        h, start, left, full, item, need, at = [], [], [], [], [], [], 0
        first = 0
        for block in blocks(pa.array(texts, pa.string()), "ascii", True):
            hashes = block.hashes()
            for i in range(block.hi - block.lo):
                own = hashes[block.first[i] : block.first[i + 1]]
                n = len(own)
                h.append(np.append(own, np.uint64(0)))
                start.append(at + np.arange(n))
                left.append(n - np.arange(n))
                full.append(np.full(n, n))
                item.append(np.full(n, first + i))
                w = min(width, n)
                need.append(np.where(np.arange(n) <= n - w, w, 0))
                at += n + 1
            first += block.hi - block.lo
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        h = cat(h, np.uint64)
        vocabulary = np.unique(h[h != 0])
        ranks = np.where(h == 0, 0, np.searchsorted(vocabulary, h) + 1)
        start, left, full, item, need = (cat(x, np.int32) for x in (start, left, full, item, need))
        words = h[start]
        ends = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=len(ids)))])
        starts = {}
        for n in np.unique(need[need > 0]).tolist():
            at, hashes = windows(words, ends, n)
            own = need[at] == n
            order = np.argsort(hashes[own], kind="stable")
            starts[n] = hashes[own][order], at[own][order].astype(np.int32)
        return cls(vocabulary, ranks.astype(np.int32), start, left, full, item, need, ids, starts)

    def near(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The suffixes whose window may be in a shard (words by hash, ``first`` as in a block)."""
        found = []
        for n, (own, suffix) in self.starts.items():
            _, there = windows(hashes, first, n)
            at = np.searchsorted(own, there)
            at[at == len(own)] = 0
            there = np.unique(there[own[at] == there])
            _, places = expanded(np.searchsorted(own, there), np.searchsorted(own, there, "right"))
            found.append(suffix[places])
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int32)


def ranked(hashes: np.ndarray, first: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Ranks of a shard's words with a 0 after each document; words no item has are 0 too.

    A word that no item has ends every match, as the end of a document does.
    """
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    rank = np.where(vocabulary[at] == hashes, at + 1, 0) if len(vocabulary) else np.zeros(len(hashes), np.int64)
    out = np.zeros(len(hashes) + len(first) - 1, np.int64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = rank
    return out


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a shard in the order of their first ``depth`` words (or more), by doubling.

    A suffix whose next word is 0 has ended: no match goes on from there. Suffixes that start
    with 0 match nothing and are left out. Each round sorts only what is still tied.
    """
    order = np.flatnonzero(ranks)
    key = ranks.copy()
    tied = order
    done = 1
    order = order[np.argsort(key[order], kind="stable")]
    while done < depth and len(tied):
        # places in the order of groups with one key so far
        k = key[order]
        new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sizes = np.diff(np.append(new, len(order)))
        group = np.repeat(new, sizes)  # a group's key: its first place
        key = np.zeros(len(ranks), np.int64)
        key[order] = group + 1
        open_ = np.repeat(sizes > 1, sizes)
        places = np.flatnonzero(open_)
        tied = order[places]
        if not len(tied):
            break
        after = tied + done
        second = np.where(after < len(ranks), key[np.minimum(after, len(ranks) - 1)], 0)
        width = len(order) + 2
        rank = np.argsort(key[tied] * width + second, kind="stable")
        order[places] = tied[rank]
        pair = key[tied] * width + second
        # the new key of a tied suffix: the first place of those equal in both halves
        pair = pair[rank]
        starts = np.append(True, pair[1:] != pair[:-1])
        key[order[places]] = places[np.maximum.accumulate(np.where(starts, np.arange(len(places)), 0))] + 1
        done *= 2
    return order


def search(order: np.ndarray, ranks: np.ndarray, s: Suffixes, depth: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest match of every suffix, or of ``some`` only (to ``depth`` words), one place of it, and the range of its window."""
    n = len(s.start)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order))
    longest, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    wlo, whi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n) if some is None else some
    padded = np.append(ranks, np.zeros(depth + 1, np.int64))

    def bound(lo, hi, want, d, right):
        lo, hi = lo.copy(), hi.copy()
        while (go := lo < hi).any():
            mid = (lo + hi) >> 1
            word = padded[order[np.where(go, mid, 0)] + d]
            less = go & ((word <= want) if right else (word < want))
            lo = np.where(less, mid + 1, lo)
            hi = np.where(go & ~less, mid, hi)
        return lo

    for d in range(depth):
        live = live[(s.left[live] > d)]
        if not len(live):
            break
        want = s.ranks[s.start[live] + d]
        a = bound(lo[live], hi[live], want, d, False)
        b = bound(a, hi[live], want, d, True)
        found = a < b
        live, a, b = live[found], a[found], b[found]
        lo[live], hi[live], longest[live], place[live] = a, b, d + 1, order[a] if len(a) else a
        at = live[s.need[live] == d + 1]
        wlo[at], whi[at] = lo[at], hi[at]
    return longest, place, wlo, whi


def expanded(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range's index and every place in it."""
    n = hi - lo
    owner = np.repeat(np.arange(len(lo)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[owner]


def shard_matches(block: Block, s: Suffixes, width: int) -> Iterator[dict]:
    """The columns of MATCHES but the id for each document of a shard."""
    docs = block.hi - block.lo
    n_words = np.diff(block.first)
    hashes = block.hashes()
    ranks = ranked(hashes, block.first, s.vocabulary)
    some = s.near(hashes, block.first)
    begin = block.first + np.arange(len(block.first))  # of each document in ranks
    covered = np.zeros(len(ranks) + 1, np.int64)
    found = {}
    if len(some):
        depth = 1 << max(1, (width - 1).bit_length())
        order = suffix_array(ranks, depth)
        _, _, lo, hi = search(order, ranks, s, width, some)
        # equal windows share their places: mark words once for each distinct window
        some = some[hi[some] > lo[some]]
        heads = np.unique(np.stack([lo[some], hi[some], s.need[some]], 1), axis=0)
        owner, at = expanded(heads[:, 0], heads[:, 1])
        places, need = order[at], heads[owner, 2]
        np.add.at(covered, places, 1)
        np.add.at(covered, places + need, -1)
        # matches that can't be grown to the left, one or more for each document and item
        for j in some:
            at = order[lo[j] : hi[j]]
            if s.left[j] < s.full[j]:
                before = ranks[np.maximum(at - 1, 0)]
                at = at[(at == 0) | (before == 0) | (before != s.ranks[s.start[j] - 1])]
            for place, doc in zip(at.tolist(), (np.searchsorted(begin, at, "right") - 1).tolist(), strict=True):
                found.setdefault(doc, {}).setdefault(int(s.item[j]), []).append((int(j), place))
    hit = np.cumsum(covered[:-1]) > 0
    for d in range(docs):
        own = hit[begin[d] : begin[d] + n_words[d]]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
        items = []
        for item, at in found.get(d, {}).items():
            best = max((grown(ranks, s, place, j) for j, place in at), key=lambda x: (x[0], -x[1], -x[2]))
            items.append({"item_id": s.ids[item], "longest": best[0], "item_word": best[1], "doc_word": int(best[2] - begin[d])})
        yield {"n_words": int(n_words[d]), "n_hit": int(own.sum()), "spans": spans, "items": items}


def grown(ranks: np.ndarray, s: Suffixes, place: int, j: int) -> tuple[int, int, int]:
    """Length, word in the item and place of the match at suffix j, grown to the right."""
    start, left = s.start[j], s.left[j]
    own = ranks[place : place + left]
    differ = np.flatnonzero((own != s.ranks[start : start + len(own)]) | (own == 0))
    n = int(differ[0]) if len(differ) else len(own)
    return n, int(s.full[j] - left), place


def suffix_blocks(benchmark: DataFrame, width: int, item_col: str = "item_id", text_col: str = "text") -> Iterator[Suffixes]:
    """The benchmark's suffixes in blocks of at most BENCHMARK_BLOCK_BYTES of text (a longer item stands alone), each
    built when it is asked for: about 50 bytes a word, and one block at a time on the driver and in a task."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    ids: list[str | None] = []
    texts: list[str] = []
    size = 0
    for row in items.toLocalIterator():
        own = len(row.t.encode())
        if size and size + own > BENCHMARK_BLOCK_BYTES:
            yield Suffixes.of(ids, texts, width)
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += own
    yield Suffixes.of(ids, texts, width)


def joined(before: dict, more: dict) -> dict:
    """The matches of one document in some blocks and in a further one: spans that meet are one span."""
    spans: list[dict] = []
    for x in sorted([*before["spans"], *more["spans"]], key=lambda x: x["start"]):
        if spans and x["start"] <= spans[-1]["stop"]:
            spans[-1]["stop"] = max(spans[-1]["stop"], x["stop"])
        else:
            spans.append(dict(x))
    return {"n_words": more["n_words"], "n_hit": sum(x["stop"] - x["start"] for x in spans), "spans": spans, "items": [*before["items"], *more["items"]]}


def matches(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """Per document: id, n_words, n_hit, hit spans (words) and, for each item with an occurring
    window, the longest match and where it is. One row for each input row.

    The benchmark is read in blocks of at most BENCHMARK_BLOCK_BYTES, one at a time on the driver; the
    documents are passed over once for each block (one block for any usual benchmark), and
    the rows carry what earlier blocks found. With several blocks each pass but the last is saved with the texts,
    so that no more than one block is in a task's memory.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    schema = MATCHES.format(id=kind)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(rows: DataFrame, s: Suffixes, last: bool) -> tuple[DataFrame, Broadcast]:
        """Rows: id, text and, after the first pass, the columns found so far; the last pass drops the text."""
        shared = documents.sparkSession.sparkContext.broadcast(s)
        carried = len(rows.columns) > 2

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch.column(1), "ascii", True):
                    own = batch.slice(block.lo, block.hi - block.lo)
                    found = list(shard_matches(block, shared.value, width))
                    if carried:
                        found = [joined(a, b) for a, b in zip(own.select(_ARROW.names).to_pylist(), found, strict=True)]
                    out = pa.Table.from_pylist(found, schema=_ARROW)
                    kept = [own.column(0)] if last else [own.column(0), own.column(1)]
                    yield pa.RecordBatch.from_arrays([*kept, *(c.combine_chunks() for c in out.columns)], names=[*["id", "text"][: len(kept)], *out.column_names])

        return rows.mapInArrow(scan, schema if last else schema.replace(f"id {kind}", f"id {kind}, text string", 1)), shared

    parts = suffix_blocks(benchmark, width, item_col, item_text_col)
    s = next(parts)
    while (more := next(parts, None)) is not None:
        found, shared = run(rows, s, False)
        rows = saved(found, "decontamination-matches")
        shared.unpersist()
        s = more
    return run(rows, s, True)[0]


_ARROW = pa.schema([
    ("n_words", pa.int64()),
    ("n_hit", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ("items", pa.list_(pa.struct([("item_id", pa.string()), ("longest", pa.int32()), ("item_word", pa.int32()), ("doc_word", pa.int32())]))),
])


def decontaminated(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns.

    With several benchmark blocks what is left is saved before each further one, as in ``matches``.
    """
    at = documents.columns.index(text_col)

    def run(rows: DataFrame, s: Suffixes) -> tuple[DataFrame, Broadcast]:
        shared = documents.sparkSession.sparkContext.broadcast(s)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch.column(at), "ascii", True):
                    clean = [not r["n_hit"] for r in shard_matches(block, shared.value, width)]
                    yield batch.slice(block.lo, block.hi - block.lo).filter(pa.array(clean))

        return rows.mapInArrow(scan, documents.schema), shared

    rows, parts = documents, suffix_blocks(benchmark, width, item_col, item_text_col)
    s = next(parts)
    while (more := next(parts, None)) is not None:
        found, shared = run(rows, s)
        rows = saved(found, "decontamination-clean")
        shared.unpersist()
        s = more
    return run(rows, s)[0]
