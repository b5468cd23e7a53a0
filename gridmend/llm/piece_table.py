"""A cache of encoded pieces that whole arrays of pieces are looked up in at once.

Keys are 64-bit hashes in an open-addressing table of fixed size; values are ranges of one array of ids. Pieces that the table
lacks are encoded once each and added; a table that is full starts anew with the pieces at hand. Two pieces of one text may share
a hash with a chance of about 2**-64 a pair; `TableEncoder` compares the bytes that the ids stand for with the text, and encodes
a text piece by piece if they differ, so that no clash can reach a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import pretokens
from .textarrays import _BYTE, span_hashes

SLOT_BITS, MAX_PIECES = 21, 700_000
_U = np.uint64


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of ranges one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class PieceTable:
    def __init__(self, slot_bits: int = SLOT_BITS, limit: int = MAX_PIECES):
        self.shift, self.mask, self.limit = _U(64 - slot_bits), (1 << slot_bits) - 1, limit
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.mask + 1, np.uint64)  # 0 marks a free slot
        self.entry = np.zeros(self.mask + 1, np.int32)
        self.starts, self.lengths, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.n = self.used = 0

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash the slot that holds it, or the free one at which the search ended; and whether it was found."""
        slot = (hashes >> self.shift).astype(np.int64)
        there = self.keys[slot]
        found = there == hashes
        open_ = np.flatnonzero(~found & (there != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == hashes[open_]
            found[open_[hit]] = True
            open_ = open_[~hit & (there != 0)]
        return slot, found

    def _add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """New and distinct hashes with the ids of each, one after another."""
        n, used = self.n + len(hashes), self.used + len(ids)
        for name, need in (("starts", n), ("lengths", n), ("ids", used)):
            if need > len(getattr(self, name)):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(need, getattr(self, name).dtype)]))
        self.lengths[self.n : n] = lengths
        self.starts[self.n : n] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : used] = ids
        left = np.arange(len(hashes))
        while len(left):  # of those that want one free slot, one gets it a round
            slot, _ = self._find(hashes[left])
            slot, first = np.unique(slot, return_index=True)
            self.keys[slot], self.entry[slot] = hashes[left[first]], self.n + left[first]
            left = np.delete(left, first)
        self.n, self.used = n, used

    def entries(self, hashes: np.ndarray, encode: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """The entry of each hash; encode gets the places of those that are new and gives the packed ids of each."""
        slot, found = self._find(hashes)
        if not found.all():
            missing = np.flatnonzero(~found)
            new, first = np.unique(hashes[missing], return_index=True)
            if self.n + len(new) > self.limit and self.n:
                self.clear()
                return self.entries(hashes, encode)
            packed = encode(missing[first])
            self._add(new, np.fromiter(map(len, packed), np.int64, len(packed)) // 4, np.frombuffer(b"".join(packed), "<u4"))
            slot, _ = self._find(hashes)
        return self.entry[slot].astype(np.int64)


class TableEncoder:
    """Encodes texts by pieces; encode_new gives the packed ids of pieces, token_bytes the bytes of each id."""

    def __init__(self, encode_new: Callable[[list[bytes]], list[bytes]], token_bytes: list[bytes]):
        self.encode_new, self.table = encode_new, PieceTable()
        self.lengths = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(token_bytes), np.uint8)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the place in them at which each text ends, after a 0."""
        begins = pretokens.pieces(raw, offsets)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(begins[1:], len(raw))
        hashes = span_hashes(_BYTE[raw], begins, ends) | _U(1)
        data = raw.tobytes()
        new = lambda at: self.encode_new([data[a:b] for a, b in zip(begins[at].tolist(), ends[at].tolist())])
        entry = self.table.entries(hashes, new)
        counts = self.table.lengths[entry]
        ids = self.table.ids[ranges(self.table.starts[entry], counts)]
        if not np.array_equal(self.decode(ids)[0], raw):  # a clash of hashes
            packed = new(np.arange(len(begins)))
            counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            ids = np.frombuffer(b"".join(packed), "<u4")
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(begins, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids, and the byte at which each id ends, after a 0."""
        lengths = self.lengths[ids]
        return self.bytes[ranges(self.starts[ids], lengths)], np.append(0, np.cumsum(lengths))
