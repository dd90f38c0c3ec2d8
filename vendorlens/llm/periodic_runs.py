"""Periodic runs of words: stretches that repeat four times or more, by recursive frequency splitting.

A run of length L and smallest period q has L >= max(6, 4 * q), so each of its words occurs at least four times in it.
A word that occurs fewer times in a segment can therefore be in no run of that segment, and splits it; the
pieces are counted anew until no piece holds such a word. What survives is scanned at each lag q up to a quarter of its length.
Where a run of period q is, words q apart are equal in a stretch of 3 * q places, which holds three multiples of q in a
row. So only multiples of q are compared at first, n / q of them, and stretches are followed word by
word only where three in a row agree. Lags go up; a stretch that lies in a run of smaller period repeats that run
(two periods of one stretch have a common divisor for period), and is skipped.

All texts of a block are split and scanned together, with marks that equal nothing between them. Words are told apart by
64-bit hashes of their bytes.

Defined cases: null and empty texts have no words and no run; the kept text of a row is its kept words joined by one blank;
repeated rows are handled each by itself; a very long text is a block of its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorlens.llm.words import Block, blocks

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of words compared at once, and places at which a stretch is tried before it is followed.
PAIRS, PROBES = 1 << 18, 16
#: Words counted before splitting ends, for each word of the block; what is left then is scanned as it is, with the same runs.
COUNTED = 32


def split(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of the segments [lo, hi) without a word that occurs too rarely in its piece, by start."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    kinds = int(codes.max()) + 1 if len(codes) else 1
    left = COUNTED * len(codes)
    while True:
        long = hi - lo >= LEAST_WORDS
        lo, hi = lo[long], hi[long]
        size = hi - lo
        left -= int(size.sum())
        if not len(lo) or left < 0:
            done.append((lo, hi))
            break
        segment = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(segment)) + np.repeat(lo - (np.cumsum(size) - size), size)
        _, place, count = np.unique(segment * kinds + codes[at], return_inverse=True, return_counts=True)
        keep = (count >= LEAST_PERIODS)[place]
        whole = np.logical_and.reduceat(keep, np.cumsum(size) - size)
        done.append((lo[whole], hi[whole]))
        keep &= ~whole[segment]
        apart = np.flatnonzero(np.diff(segment)) + 1
        begins, stops = keep.copy(), keep.copy()
        begins[1:] &= ~keep[:-1]
        begins[apart] = keep[apart]
        stops[:-1] &= ~keep[1:]
        stops[apart - 1] = keep[apart - 1]
        lo, hi = at[begins], at[stops] + 1
    lo, hi = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(lo, kind="stable")
    return lo[order], hi[order]


def _first_apart(words: np.ndarray, at: int, lag: int) -> int:
    """The first place from ``at`` on whose word isn't the one ``lag`` later."""
    step, end = 64, len(words) - lag
    while at < end:
        stop = min(end, at + step)
        apart = words[at:stop] != words[at + lag : stop + lag]
        if apart.any():
            return at + int(apart.argmax())
        at, step = stop, 2 * step
    return end


def _last_apart(words: np.ndarray, at: int, lag: int) -> int:
    """The place after the last before ``at`` whose word isn't the one ``lag`` later."""
    step = 64
    while at > 0:
        start = max(0, at - step)
        apart = words[start:at] != words[start + lag : at + lag]
        if apart.any():
            return at - int(apart[::-1].argmax())
        at, step = start, 2 * step
    return 0


def _candidates(words: np.ndarray, lags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) where the words at three multiples of the lag in a row equal those a lag later."""
    lag = np.repeat(lags, counts)
    place = (np.arange(len(lag)) - np.repeat(np.cumsum(counts) - counts, counts)) * lag
    same = words[place] == words[place + lag]
    three = same[:-2] & same[1:-1] & same[2:] & (lag[:-2] == lag[2:])
    found = np.flatnonzero(three)
    return lag[found], place[found]


def scan(words: np.ndarray, reach: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs; ``reach[q]`` are the words at the start that a run of period q can be in."""
    out: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    table = np.zeros((64, 3), np.int64)  # what is in ``out``
    longest = np.full(len(words), -1, np.int32)  # the longest run that covers each word

    def free(lag: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether stretches may be more than repeats of a known run."""
        ok = np.ones(len(lag), bool)
        for k in range(4) if out else ():
            run = longest[place + k * lag]
            start, end, period = table[run].T
            ok &= (run < 0) | (np.minimum(place + 3 * lag + 1, end) - np.maximum(place, start) < period + lag)
        return ok

    q, last = 1, len(reach) - 1
    while q <= last:
        stop = q
        pairs = 0
        while stop <= last and (stop == q or pairs + reach[stop] // stop <= PAIRS):
            pairs += int(reach[stop]) // stop
            stop += 1
        lags = np.arange(q, stop)
        lag, place = _candidates(words, lags, np.maximum((reach[q:stop] - 1) // lags, 0))
        q = stop
        ok = free(lag, place)
        lag, place = lag[ok], place[ok]
        for k in range(1, PROBES + 1):
            at = place + 2 * lag * k // (PROBES + 1)
            same = words[at] == words[at + lag]
            lag, place = lag[same], place[same]
        cuts = np.flatnonzero(np.diff(lag)) + 1
        for places, lags in zip(np.split(place, cuts), np.split(lag, cuts), strict=True) if len(lag) else ():
            own = int(lags[0])
            places = places[free(lags, places)]
            i = 0
            while i < len(places):
                at = int(places[i])
                start, end = _last_apart(words, at, own), _first_apart(words, at, own) + own
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * own) and (start, end) not in known:
                    known.add((start, end))
                    if len(out) == len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    part = longest[start:end]
                    part[(part < 0) | (table[part, 1] - table[part, 0] < end - start)] = len(out)
                    table[len(out)] = start, end, own
                    out.append((start, end, own))
                i = max(i + 1, int(np.searchsorted(places, end - 2 * own, "right")))  # those before lie in this stretch
    return out


def runs_of(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and then period. ``first[i]:first[i + 1]`` are the words of text i."""
    lo, hi = split(codes, first[:-1], first[1:])
    if not len(lo):
        return np.empty((0, 3), np.int64)
    order = np.argsort(lo - hi, kind="stable")  # long segments first, so that a lag looks at the start of the array only
    lo, size = lo[order], (hi - lo)[order]
    begin = np.cumsum(size + 1) - size - 1
    words = np.empty(int((size + 1).sum()), np.int64)
    words[begin + size] = -1 - np.arange(len(size))
    inside = words >= 0
    inside[:] = True
    inside[begin + size] = False
    words[inside] = codes[np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)]
    lags = np.arange(int(size[0]) // LEAST_PERIODS + 1)
    fit = np.searchsorted(-size, -np.maximum(LEAST_WORDS, LEAST_PERIODS * lags), "right")
    ends = np.concatenate([[0], begin + size])
    found = scan(words, ends[fit])
    if not found:
        return np.empty((0, 3), np.int64)
    out = np.array(found, np.int64)
    shift = (lo - begin)[np.searchsorted(begin, out[:, 0], "right") - 1]
    out[:, :2] += shift[:, None]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept_texts(block: Block, dropped: np.ndarray) -> pa.Array:
    """The words of each row that aren't dropped, joined by one blank."""
    data, kept = block.data.copy(), np.flatnonzero(~dropped)
    row = np.searchsorted(block.first, kept, "right") - 1
    ends = block.ends[kept]
    more = np.zeros(len(kept), np.int64)
    more[:-1] = row[1:] == row[:-1]  # a blank follows, in place of the mark after the word
    data[ends[more == 1]] = 0x20
    turns = np.zeros(len(data) + 2, np.int8)
    turns[block.starts[kept]] += 1
    turns[ends + more] -= 1
    lengths = np.bincount(row, weights=ends - block.starts[kept] + more, minlength=block.hi - block.lo)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    text = data[np.cumsum(turns[: len(data)], dtype=np.int8) > 0]
    return pa.StringArray.from_buffers(block.hi - block.lo, pa.py_buffer(offsets), pa.py_buffer(text))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scanned(block: Block) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(words, runs, kept text) of each row of a block."""
    _, codes = np.unique(block.hashes(), return_inverse=True)
    runs = runs_of(codes, block.first)
    turns = np.zeros(len(codes) + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 1], -1)
    row = np.searchsorted(block.first, runs[:, 0], "right") - 1
    parts = (runs[:, 0] - block.first[row], runs[:, 1] - runs[:, 0], runs[:, 2])
    structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], fields=list(_RUN))
    listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(block.hi - block.lo + 1)), pa.int32()), structs)
    return pa.array(np.diff(block.first), pa.int64()), listed, kept_texts(block, np.cumsum(turns[:-1]) > 0)


def periodic_runs(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, kept_text) for each row: ``runs`` as (start, length, period) in words, by start and then period;
    ``kept_text`` without the words that a run holds after its first period."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), "space", False):
                n_words, runs, kept = _scanned(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), n_words, runs, kept], names=["id", "n_words", "runs", "kept_text"])

    kind = documents.schema[id_col].dataType.simpleString()
    runs = "array<struct<start:long,length:long,period:long>>"
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(texts, f"id {kind}, n_words long, runs {runs}, kept_text string")


def collapsed(documents: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with each run cut to its first period in the text; texts without a run, and other columns, stay as they are."""
    at = documents.columns.index(text_col)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at), "space", False):
                own = batch.slice(block.lo, block.hi - block.lo)
                _, runs, kept = _scanned(block)
                new = [k if r else t for t, r, k in zip(own.column(at).to_pylist(), runs.value_lengths().to_pylist(), kept.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, c.type) if k == at else c for k, c in enumerate(own.columns)], schema=own.schema)

    return documents.mapInArrow(texts, documents.schema)
