"""Which of very many words are in which texts: a helper for tasks, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are worked on at once; a longer text is taken in pieces.
CHUNK_BYTES = 1 << 18
#: Texts whose words are put into bits together.
TEXTS = 64


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, with one after each that no UTF-8 text has, and where each text begins (and the last ends)."""
    data = b"\xff".join([t or b"" for t in texts.cast(pa.large_binary()).to_pylist()] + [b""])
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(_sizes(texts) + 1)])


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for each two: both side by side, or their hash to 64 bits."""
    if left.itemsize < 8:
        kind = np.dtype(f"u{2 * left.itemsize}").type
        found = right.astype(kind)
        found <<= kind(8 * left.itemsize)
        found |= left
        return found
    found = left * np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    found += right
    found *= np.uint64(0x94D049BB133111EB)
    found ^= found >> np.uint64(29)
    return found


def _windows(data: np.ndarray, wanted: set[int]) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
    """The windows that begin at each byte, as numbers, by their size: those wanted of 1, 2, 3, 4, 6, 8, 12, 16, ... bytes; and the last power of two with its windows."""
    size, found, most = 1, data, max(wanted, default=0)
    while size <= most and len(found):
        if size in wanted:
            yield size, found, size, found
        if (half := size // 2) and size + half in wanted and len(found) > half:
            yield size + half, _pairs(found[:-half], found[half:]), size, found
        found = _pairs(found[:-size], found[size:])
        size *= 2


def _kinds(lengths: np.ndarray) -> np.ndarray:
    """The largest of 0, 1, 2, 3, 4, 6, 8, 12, 16, ... that isn't over the length."""
    power = 1 << np.log2(np.maximum(lengths, 1)).astype(np.int64)
    return np.where(lengths > 0, power + np.where((power > 1) & (lengths >= power + power // 2), power // 2, 0), 0)


class _Words:
    """Words by the window that they begin with. Some are no longer than it."""

    def __init__(self, keys: np.ndarray, words: np.ndarray, longer: np.ndarray, none: int):
        self.direct, self.bits = keys.itemsize <= 2, 8 * keys.itemsize
        if not self.direct:
            self.bits = min(22, max(12, 2 + len(words).bit_length()))
        slots = self._slots(keys)
        order = np.lexsort((longer, keys, slots))
        keys, slots, words, longer = keys[order], slots[order], words[order], longer[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.words, self.whole = words, np.append(np.where(longer[first], none, words[first]), none)  # the last one here and below is that of -1
        self.longer = np.append(np.diff(np.append(first, len(words))) - ~longer[first], 0)
        self.first, self.keys, slots = np.append(first + ~longer[first], 0), np.append(keys[first], keys[:1]), slots[first]
        self.table = np.full(1 << self.bits, -1, np.int32)  # the first key of each slot; others follow it
        self.table[slots[::-1]] = np.arange(len(slots), dtype=np.int32)[::-1]
        self.more = np.concatenate([slots[1:] == slots[:-1], [False, False]])
        self.any_longer, self.any_whole = bool(longer.any()), not longer.all()

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        if self.direct:
            return keys
        if keys.itemsize == 4:
            return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def places(self, windows: np.ndarray) -> np.ndarray:
        """The key that each of the windows is, or -1."""
        place = self.table[self._slots(windows)]
        if self.direct:
            return place
        same = self.keys[place] == windows
        rest = np.flatnonzero(self.more[place] > same)
        while len(rest):
            place[rest] += 1
            now = self.keys[place[rest]] == windows[rest]
            same[rest[now]] = True
            rest = rest[self.more[place[rest]] > now]
        same &= place >= 0
        place |= same.astype(np.int32) - 1
        return place


class Substrings:
    """An index of distinct words. It takes some 80 bytes a word with its tables, of at most 16 MB for each kind of length.

    The time for a text depends on its length and its matches, not on the number of words. Windows of 1, 2, 3, 4, 6, 8, 12, ... bytes are looked up as
    beginnings of words, each word by the longest that it has; for a longer word the window that would end it is compared too.
    """

    def __init__(self, words: pa.Array):
        self.n = len(words)
        self.lengths = _sizes(words)
        self.longest = int(self.lengths.max(initial=0))
        kind = _kinds(self.lengths)
        self.blank = np.flatnonzero(self.lengths == 0)
        sizes = sorted(set(kind.tolist()) - {0})
        begins, self.finish = np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)
        for at, end in _stretches(self.lengths):
            data, starts = _joined(words.slice(at, end - at))
            for size, windows, power, powers in _windows(data, set(kind[at:end].tolist()) - {0}):
                own = np.flatnonzero(kind[at:end] == size)
                begins[at + own], self.finish[at + own] = windows[starts[own]], powers[starts[own] + self.lengths[at + own] - power]
        self.kinds: dict[int, _Words] = {}
        for size in sizes:
            own = np.flatnonzero(kind == size)
            number = {1: np.uint8, 2: np.uint16, 3: np.uint32, 4: np.uint32}.get(size, np.uint64)
            self.kinds[size] = _Words(begins[own].astype(number), own, self.lengths[own] > size, self.n)

    def _hits(self, kind: _Words, windows: np.ndarray, power: int, powers: np.ndarray) -> Iterator[tuple[np.ndarray | None, np.ndarray]]:
        """Places, rising, and the words there; None for places stands for all of them, and the number of words for none."""
        place = kind.places(windows)
        if kind.any_whole:
            if 2 * np.count_nonzero(place >= 0) > len(place):
                yield None, kind.whole[place]
            else:
                at = np.flatnonzero(place >= 0)
                yield at, kind.whole[place[at]]
        if kind.any_longer:
            at = np.flatnonzero(kind.longer[place])
            place = place[at]
            many = kind.longer[place]
            at, word = np.repeat(at, many), kind.words[np.repeat(kind.first[place] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            last = at + self.lengths[word] - power
            same = powers[np.minimum(last, len(powers) - 1)] == self.finish[word]
            same &= last < len(powers)
            yield at[same], word[same]

    def _pieces(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The joined texts, or pieces of a single long one that overlap by what a word may need."""
        data, starts = _joined(texts)
        step = max(CHUNK_BYTES, self.longest)
        if len(texts) > 1 or len(data) <= step:
            yield data, starts
            return
        for at in range(0, len(data), step):
            piece = data[at : at + step + self.longest]
            yield piece, np.array([0, len(piece)])

    def find(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For stretches [begin, end) of the texts: rows, counted from begin, and words in them, each pair once, rising. Nulls have no words."""
        if not self.n:
            return
        for begin, end in _stretches(_sizes(texts)):
            own = texts.slice(begin, end - begin)
            valid = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
            pairs = np.repeat(valid, len(self.blank)) * self.n + np.tile(self.blank, len(valid))
            for data, starts in self._pieces(own):
                found = [pairs]
                for size, *windows in _windows(data, set(self.kinds)):
                    for at, word in self._hits(self.kinds[size], *windows):
                        if at is None or self.kinds[size].any_longer:
                            here = np.flatnonzero(word < self.n)
                            at, word = here if at is None else at[here], word[here]
                        found.append(np.repeat(np.arange(end - begin), np.diff(np.searchsorted(at, starts))) * self.n + word)
                pairs = np.concatenate(found)
                if (end - begin) * self.n <= 16 * len(pairs) + 4096:
                    seen = np.zeros((end - begin) * self.n, bool)
                    seen[pairs] = True
                    pairs = np.flatnonzero(seen)
                else:
                    pairs = np.unique(pairs)
            yield begin, end, pairs // self.n, pairs % self.n

    def marks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        """For stretches [begin, end) of 64 texts at most: a number for each word, whose bit i is set if text begin + i has it, and after them a 0. Nulls have no words."""
        flags = np.zeros(1 << 16, bool)
        for begin in range(0, len(texts), TEXTS):
            own = texts.slice(begin, TEXTS)
            marks = np.zeros(self.n + 1, np.uint64)
            marks[self.blank] = np.uint64(sum(1 << i for i, valid in enumerate(own.is_valid().to_pylist()) if valid))
            for first, end in _stretches(_sizes(own)):
                bits = [np.uint64(1 << i) for i in range(first, end)]
                for data, starts in self._pieces(own.slice(first, end - first)):
                    bounds = starts.tolist()
                    for size, *windows in _windows(data, set(self.kinds)):
                        kind = self.kinds[size]
                        if size <= 2:  # which bytes, or two together, a text has at all
                            all_places = windows[0].astype(np.int64)
                            for i, bit in enumerate(bits):
                                flags[all_places[bounds[i] : bounds[i + 1]]] = True
                                marks[kind.whole[:-1][flags[kind.keys[:-1]]]] |= bit
                                flags.fill(False)
                            continue
                        for at, word in self._hits(kind, *windows):
                            cut = bounds if at is None else np.searchsorted(at, starts).tolist()
                            for i, bit in enumerate(bits):
                                if cut[i] < cut[i + 1]:
                                    marks[word[cut[i] : cut[i + 1]]] |= bit
            marks[-1] = 0
            yield begin, begin + len(own), marks


def _stretches(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts [begin, end) of CHUNK_BYTES together, or a longer one alone."""
    begin = 0
    while begin < len(sizes):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin : begin + 16384]), CHUNK_BYTES, side="right")))
        yield begin, end
        begin = end


_KEPT: list = []


def kept(token: str, make: Callable):
    """What ``make`` gives, kept by a worker for its next tasks with the same token; one at a time."""
    if not _KEPT or _KEPT[0] != token:
        _KEPT.clear()
        _KEPT[:] = [token, make()]
    return _KEPT[1]
