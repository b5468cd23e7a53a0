"""Token counts by rank-synchronous merging of arrays.

The distinct pieces of a batch that the cache lacks lie in one ragged array of symbols. In each round every piece merges
all places of its own lowest-ranked pair at once, and the array is compacted; a piece with no known pair leaves with the
number of its symbols. A document's count is the sum over its pieces. One pass over the rows, with no shuffle.

Defined results: a null or empty text has no bytes and no tokens. A special string of the tokenizer file inside a text is
one token, as is that library's default. Rows that repeat are each counted; other columns pass through, and a column with
the name of a new one is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_PIECES = 400_000
LIMIT = 1024
TEXTS_AT_ONCE = 128
#: Fixed value: the split of the byte-level pre-tokenizer, with Unicode's white space named.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The character that stands for each byte in the file's tokens: itself if it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class Merges:
    """The merges of a tokenizer file as sorted arrays: pair of ids -> rank and id of the merged token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids = file["model"]["vocab"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in file["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.none = np.int32(len(pairs))
        self.bytes = np.array([ids[c] for c in byte_letters()], np.int64)
        special = [x["content"] for x in file.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PIECES)
        self.cache: dict[str, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], self.none)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols are left of each piece when no pair can merge any more; pieces aren't empty."""
        out = np.zeros(len(pieces), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        own = np.arange(len(pieces))
        symbols = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        while len(own):
            starts = np.cumsum(sizes) - sizes
            ranks = np.full(len(symbols), self.none)
            if len(symbols) > 1:
                ranks[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
            ranks[starts + sizes - 1] = self.none  # the last symbol of a piece has no right neighbour
            best = np.minimum.reduceat(ranks, starts)
            done = best == self.none
            out[own[done]] = sizes[done]
            keep = np.repeat(~done, sizes)
            symbols, ranks, own, best, sizes = symbols[keep], ranks[keep], own[~done], best[~done], sizes[~done]
            if not len(own):
                break
            hit = ranks == np.repeat(best, sizes)
            # of a run of hits, as in aaaa, every other one merges, from the left
            at = np.flatnonzero(hit)
            run = np.append(True, np.diff(at) > 1)
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            sizes = np.add.reduceat(stay, np.cumsum(sizes) - sizes, dtype=np.int64)
            symbols = symbols[stay]
        return out

    def split(self, text: str) -> tuple[list[str], int]:
        """The pieces of a text, and how many special tokens stand between them."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.pattern.findall(part)], len(parts) - 1

    def tokens(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        new = list(set().union(*[p for p, _ in split]) - self.cache.keys())
        self.cache.update(zip(new, self.count([p.encode() for p in new]).tolist()))
        known = self.cache.__getitem__
        return [sum(map(known, p)) + n for p, n in split]


@cache
def merges(path: str) -> Merges:
    """One per Python worker, however many tasks it runs."""
    return Merges(path)


def _counter(path: str):
    @F.arrow_udf(T.LongType())
    def count_tokens_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = merges(path)
        for column in batches:
            out: list[int] = []
            for k in range(0, len(column), TEXTS_AT_ONCE):
                out += own.tokens([t or "" for t in column.slice(k, TEXTS_AT_ONCE).to_pylist()])
            yield pa.array(out, pa.int64())

    return count_tokens_of


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit."""
    made = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return made.withColumn("n_tokens", _counter(path)(F.col("text"))).withColumn("over_limit", F.col("n_tokens") > limit)
