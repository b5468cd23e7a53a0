"""Byte-level BPE encoding and decoding by a public rank file.

Pieces come from `pretokens`; each distinct piece is merged once and its ids are kept in a table of bounded size in the Python
worker (`piece_table`), in which all pieces of a batch are looked up at once. `encode` adds ids and byte offsets of each token, `decode` the bytes of ids. Every stage is one pass over
the rows, with no shuffle.

Defined results: a null or empty text has no tokens, and null or empty ids decode to no bytes. Rows that repeat are each
encoded. Other columns pass through; a column with the name of a new one is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .piece_table import TableEncoder
from .textarrays import texts

#: Pieces of more bytes than this are merged with a heap.
LONG_PIECE = 48


class Ranks(TableEncoder):
    """A rank file: token bytes -> id, where a lower id merges earlier."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        size = max(self.ids.values()) + 1
        by_id = [b""] * size
        for token, i in self.ids.items():
            by_id[i] = token
        self.packed = {token: i.to_bytes(4, "little") for token, i in self.ids.items()}
        super().__init__(lambda pieces: [self.merge(p) for p in pieces], by_id)

    def merge(self, piece: bytes) -> bytes:
        if piece in self.packed:
            return self.packed[piece]
        parts = self._merge_long(piece) if len(piece) > LONG_PIECE else self._merge(piece)
        return b"".join([self.packed[p] for p in parts])

    def _merge(self, piece: bytes) -> list[bytes]:
        rank, none = self.ids.get, len(self.packed)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        near = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while near and (best := min(near)) < none:
            i = near.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i < len(near):
                near[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                near[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        n, rank = len(piece), self.ids.get
        end, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            middle = end[i]
            if gone[i] or middle >= n or end[middle] != to:
                continue  # one of the two has changed since
            gone[middle] = 1
            end[i] = to
            if to < n:
                before[to] = i
                if (r := rank(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (p := before[i]) >= 0 and (r := rank(piece[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        return [piece[i : end[i]] for i in range(n) if not gone[i]]


@cache
def ranks(path: str) -> Ranks:
    """One per Python worker, however many tasks it runs."""
    return Ranks(path)


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _joined(made: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(made) if made else pa.array([], kind)


_ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("token_starts", T.ArrayType(T.IntegerType(), False))])
_ENCODED_ARROW = pa.struct([("ids", pa.list_(pa.int32())), ("token_starts", pa.list_(pa.int32()))])


def _encoder(path: str):
    @F.arrow_udf(_ENCODED)
    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = ranks(path)
        for column in batches:
            made = []
            for _, _, raw, offsets in texts(column):
                ids, ends = own.encode(raw, offsets)
                lengths = own.lengths[ids]
                starts = np.cumsum(lengths) - lengths - np.repeat(offsets[:-1], np.diff(ends))
                made.append(pa.StructArray.from_arrays([_lists(ends, ids.astype(np.int32)), _lists(ends, starts)], fields=list(_ENCODED_ARROW)))
            yield _joined(made, _ENCODED_ARROW)

    return encode_texts


def _decoder(path: str):
    @F.arrow_udf(T.BinaryType())
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = ranks(path)
        for column in batches:
            made = []
            for k in range(0, len(column), 256):
                part = column.slice(k, 256)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                counts = np.append(0, np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                data, ends = own.decode(ids)
                made.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends[counts].astype(np.int32)), pa.py_buffer(data)]))
            yield _joined(made, pa.binary())

    return decode_ids


@F.arrow_udf(T.BinaryType())
def pack_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The ids of each list as little-endian unsigned 32-bit integers."""
    for column in batches:
        ids = column.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = 4 * np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        yield pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids and token_starts (the byte of the text at which each token begins)."""
    made = docs.withColumn("_encoded", _encoder(path)(F.col(text)))
    return made.withColumns({c: F.col("_encoded")[c] for c in ("ids", "token_starts")}).drop("_encoded")


def decoded_bytes(ids: Column, path: str) -> Column:
    """The bytes of a column of ids."""
    return _decoder(path)(ids)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded: the bytes of the ids."""
    return encoded.withColumn("decoded", decoded_bytes(F.col(ids), path))


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)
