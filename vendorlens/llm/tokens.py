"""Token ids of whole texts with a file of the tokenizers library.

A tokenizer that splits at white space gives a piece of text the same ids wherever it stands,
if the piece runs from one end of a non-white run to the next. So each block of texts is cut
there, each distinct piece is encoded once by the library and kept by a
64-bit hash (400,000 pieces at most and one block more, so a clash has a chance of 1 in 100 million a store), and
the ids are gathered by position. Texts with white space other than blanks and line feeds are encoded whole,
and so are texts that hold the string of a special token, which the library takes for that token.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from vendorlens.llm.words import Block, blocks, lower_bytes

#: White space that the library's patterns or Python's may know beside blank and line feed.
_ODD_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: Pieces kept in a worker; beyond that the store starts anew.
KEPT_PIECES = 400_000


class Encoder:
    """One tokenizer file in one worker. ``spaced``: white space before a piece belongs to it
    (byte-level); otherwise it is dropped and A-Z are lower-cased before the store is asked."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library takes out of a text before all else.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = self.tokenizer.normalizer is None
        self._clear()

    def _clear(self) -> None:
        #: Sorted 64-bit hashes of the kept pieces, and where their ids are in ``flat``.
        self.keys, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, words: list[str]) -> list[np.ndarray]:
        """Ids of pieces, many to a call: joined by a mark that no such piece holds, and split at its id."""
        mark, plain = ("\n", re.compile(r" [^\s]+")) if self.spaced else (" \x01 ", re.compile(r"[^\s\x01]+"))
        sign = self._encode([mark])[0]
        out: list[np.ndarray | None] = [None] * len(words)
        easy = [i for i, w in enumerate(words) if len(sign) == 1 and plain.fullmatch(w)]
        groups = [easy[k : k + 64] for k in range(0, len(easy), 64)]
        for group, ids in zip(groups, self._encode([mark.join(words[i] for i in g) for g in groups]), strict=True):
            cuts = np.flatnonzero(ids == sign[0])
            parts = [ids[a:b] for a, b in zip([0, *(cuts + 1)], [*cuts, len(ids)], strict=True)]
            if len(parts) == len(group):
                for i, own in zip(group, parts, strict=True):
                    out[i] = own
        rest = [i for i, x in enumerate(out) if x is None]
        for i, own in zip(rest, self._encode([words[i] for i in rest]), strict=True):
            out[i] = own
        return out

    def _keep(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        size = np.array([len(x) for x in ids], np.int64)
        fresh = np.concatenate(ids)
        if self.used + len(fresh) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat), len(fresh)), np.uint32)])
        self.flat[self.used : self.used + len(fresh)] = fresh
        begin = self.used + np.cumsum(size) - size
        self.used += len(fresh)
        at = np.searchsorted(self.keys, keys)  # the new keys are sorted and not among the kept
        self.keys, self.begin, self.size = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def block(self, block: Block, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block's rows, each with ``end_id`` appended. ``texts``: the rows' strings."""
        rows = block.hi - block.lo
        data = block.data if self.spaced else lower_bytes(block.data)
        source = Block(block.lo, block.hi, data, block.starts, block.ends, block.first)
        odd = [i for i in self._suspects(block, texts) if _ODD_SPACE.search(texts[i] or "")]
        raw = lower_bytes(block.data).tobytes()
        if held := [x for x in self.special if x.lower().encode() in raw]:
            odd = sorted({*odd, *(i for i, t in enumerate(texts) if t and any(x.lower() in t.lower() for x in held))})
        starts, ends, row = self._pieces(source, texts)
        if odd:
            keep = ~np.isin(row, odd)
            starts, ends, row = starts[keep], ends[keep], row[keep]
        hashed = Block(0, 0, data, starts, ends, np.zeros(1, np.int64)).hashes()
        keys, at, piece = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_PIECES:
            self._clear()
        at_key = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at_key] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            words = [data[s:e].tobytes().decode() for s, e in zip(starts[at[new]], ends[at[new]], strict=True)]
            self._keep(keys[new], self._encode_pieces(words))
        place = np.searchsorted(self.keys, keys)
        # rows without pieces of their own: whole texts and the end ids
        extra, own = [*self._encode([texts[i] for i in odd]), np.array([end_id], np.uint32)], len(keys)
        size = np.concatenate([self.size[place], [len(x) for x in extra]]).astype(np.int64)
        flat = np.concatenate([self.flat[: self.used], *extra])
        begin = np.concatenate([self.begin[place], self.used + np.cumsum(size[own:]) - size[own:]])
        row = np.concatenate([row, np.array(odd, np.int64), np.arange(rows)])
        piece = np.concatenate([piece, own + np.arange(len(odd)), np.full(rows, len(size) - 1)])
        order = np.argsort(row, kind="stable")  # pieces in order, then the end id
        row, piece = row[order], piece[order]
        n = size[piece]
        stop = np.cumsum(n)
        ids = flat[np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - n - begin[piece], n)]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, weights=n, minlength=rows).astype(np.int64))])
        return ids, offsets

    @staticmethod
    def _suspects(block: Block, texts: list[str | None]) -> list[int]:
        """Rows with a byte that may be part of odd white space."""
        at = np.flatnonzero(_ODD_BYTES[block.data])
        if not len(at):
            return []
        cuts = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
        return np.unique(np.searchsorted(cuts, at, "right") - 1).tolist()

    def _pieces(self, block: Block, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = block.row
        if not self.spaced:
            return block.starts, block.ends, row
        cuts = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
        starts = np.concatenate([[0], block.ends[:-1]])[: len(block.ends)]
        starts = np.maximum(starts, cuts[row])
        last = np.where(np.diff(block.first) > 0, np.append(block.ends, 0)[block.first[1:] - 1], cuts[:-1])
        tail = np.flatnonzero(last < cuts[1:])  # white space at the end of a text
        all_rows = np.concatenate([row, tail])
        order = np.argsort(all_rows, kind="stable")
        return np.concatenate([starts, last[tail]])[order], np.concatenate([block.ends, cuts[1:][tail]])[order], all_rows[order]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a worker, with what it has kept."""
    return Encoder(path)


def encoded(column: pa.Array, path: str, end_id: int, limit: int = 3 << 19):
    """(lo, hi, ids, offsets) for the rows of a string column, block by block; null is empty."""
    own = encoder(path)
    for block in blocks(column, "space", False, limit):
        texts = column.slice(block.lo, block.hi - block.lo).to_pylist()
        yield block.lo, block.hi, *own.block(block, texts, end_id)


def binaries(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each row's ids as little-endian 32-bit integers in a binary column."""
    ids = np.ascontiguousarray(ids.astype("<u4"))
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
