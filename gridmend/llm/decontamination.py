"""Benchmark decontamination: every passage of every document queries a BM25 index of the benchmark's items.

Items are grouped by length, each group up to GROWTH times the least of it. A passage is a window of twice the group's longest item;
windows start that item's number of words apart, so an item that stands in a document lies whole in one of them. The index has, for
each term, its largest weight in any item, its largest weight in each block of items, and its postings. An item is retrieved if
the passage scores at least SHARE of what the item scores on itself. As in block-max WAND, sums of the largest weights rule
passages out, then sums of block weights rule out blocks, and postings are read only where a block's bound reaches the least
score that any of its items needs; nothing above the threshold is lost. The batch of passages is worked on as arrays.

Each retrieved pair is verified on words: the item's last sentence is its answer and the rest its question (a single sentence
is both). Of the question, OVERLAP of the word 5-grams must stand in the passage, of the answer OVERLAP of the words.

A benchmark of up to PASS_BYTES of text is broadcast as indexes, and the documents are read once, with no shuffle. A larger one is
split into shards of that size; the documents are read once for each, what is found is written, and no two shards' indexes
are held at a time, neither by the driver nor by the executors. Document frequencies and lengths are those of the whole benchmark.

Defined results: words are compared in lower case without ASCII punctuation. A null or empty text, or one without words, has no
leaks; items without words are never found; an empty benchmark finds nothing. Rows that repeat are each judged. An item_id that
repeats is reported once a document, with its best score; items without an id count as one whose id is null. Integer item_ids
stay integers, others become strings. Columns of docs pass through `without_leaks` as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, digest
from .textarrays import Words, span_hashes, texts

K1, B = 1.2, 0.75
SHARE, OVERLAP, N = 0.6, 0.8, 5
BLOCK, GROWTH = 8, 4
#: Text of the items whose indexes are broadcast at once; an index takes some eight times as much.
PASS_BYTES = 8 << 20
#: Entries of the matrix of bounds that a worker holds.
_BOUNDS = 1 << 21
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 0x20


def plain_words(column: pa.Array) -> Words:
    """The words of all texts in lower case without punctuation, as one piece."""
    _, _, raw, offsets = next(texts(pc.utf8_lower(column), 1 << 62))
    return Words(_PLAIN[raw], offsets)


def words_of(text: str) -> list[str]:
    return _PLAIN[np.frombuffer(pc.utf8_lower(text).as_py().encode(), np.uint8)].tobytes().decode().split()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for s in re.split(r"(?<=[.!?])\s+", text) if (w := words_of(s))]
    if len(parts) < 2:
        return words_of(text), words_of(text)
    return [w for p in parts[:-1] for w in p], parts[-1]


def _expand(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of some lengths at some places: the range of each element, and its place."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _hashes_of(lists: list[list[str]]) -> list[np.ndarray]:
    """The hash of each word of each list."""
    w = plain_words(pa.array([" ".join(x) for x in lists], pa.large_string()))
    hashes = w.hashes()
    return [hashes[a:b] for a, b in zip(w.first, w.first[1:])]


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    at = np.arange(max(len(hashes) - n + 1, 0))
    return span_hashes(hashes, at, at + n)


class Index:
    """The index of some items; frequencies: term hash -> number of items of the whole benchmark with it."""

    def __init__(self, items: list[tuple], n_items: int, mean_length: float, frequencies: dict[int, int] | None = None):
        words = plain_words(pa.array([t for _, t in items], pa.large_string()))
        hashes, rows = words.hashes(), words.row
        self.vocabulary, term = np.unique(hashes, return_inverse=True)
        v, n = len(self.vocabulary), len(items)
        keys, tf = np.unique(term * n + rows, return_counts=True)
        term, item = keys // n, keys % n
        df = np.bincount(term, minlength=v)
        if frequencies is not None:
            df = np.fromiter((frequencies.get(int(h), 1) for h in self.vocabulary.view(np.int64)), np.int64, v)
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words.counts[item] / mean_length))
        whole = np.bincount(item, weight, n)
        order = np.argsort(whole, kind="stable")  # items of like need share a block
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        item = place[item]
        by = np.lexsort((item, term))
        term, self.item, self.weight = term[by], item[by], weight[by]
        self.starts = np.searchsorted(term, np.arange(v + 1))
        self.ids = [items[i][0] for i in order]
        parts = [question_and_answer(items[i][1]) for i in order]
        questions, self.answers = (_hashes_of([p[k] for p in parts]) for k in (0, 1))
        self.sizes = [min(N, len(q)) for q in questions]
        self.questions = [np.unique(_grams(q, size)) for q, size in zip(questions, self.sizes)]
        self.need = SHARE * whole[order]
        self.need[whole[order] == 0] = np.inf
        blocks = -(-n // BLOCK)
        self.block_need = np.minimum.reduceat(self.need, np.arange(0, n, BLOCK))
        pair, first = np.unique(term * blocks + self.item // BLOCK, return_index=True)
        self.block, self.block_weight = pair % blocks, np.maximum.reduceat(self.weight, first)
        self.block_starts = np.searchsorted(pair // blocks, np.arange(v + 1))
        self.largest = np.maximum.reduceat(self.weight, self.starts[:-1])
        self.stride = int(words.counts.max())

    def scores(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all pairs that reach the item's need; (passage, term) are distinct and sorted, n counts passages."""
        near = np.bincount(passage, self.largest[term], n) >= self.block_need.min() * (1 - 1e-9)
        keep = near[passage]
        passage, term = passage[keep], term[keep]
        # passages are renumbered, so the sums are only as long as those still in question
        left, number = np.unique(passage, return_inverse=True)
        step = max(_BOUNDS // len(self.block_need), 1)
        found = []
        for k in range(0, len(left), step):
            a, b = np.searchsorted(number, [k, k + step])
            at, item, score = self._scores_of(number[a:b] - k, term[a:b], min(step, len(left) - k))
            found.append((left[k + at], item, score))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _scores_of(self, number: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        blocks = len(self.block_need)
        which, at = _expand(self.block_starts[term + 1] - self.block_starts[term], self.block_starts[term])
        bound = np.bincount(number[which] * blocks + self.block[at], self.block_weight[at], n * blocks).reshape(n, blocks)
        open_ = bound >= self.block_need[None, :] * (1 - 1e-9)
        keep = open_.any(axis=1)[number]
        term, number = term[keep], number[keep]
        which, at = _expand(self.starts[term + 1] - self.starts[term], self.starts[term])
        keep = open_[number[which], self.item[at] // BLOCK]
        which, at = which[keep], at[keep]
        pairs, where = np.unique(number[which] * len(self.ids) + self.item[at], return_inverse=True)
        score = np.bincount(where, self.weight[at], len(pairs))
        item = pairs % len(self.ids)
        hit = score >= self.need[item] * (1 - 1e-9)
        return pairs[hit] // len(self.ids), item[hit], score[hit]

    def retrieved(self, w: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, first word, end word, item, score) of the windows and items whose score is high enough."""
        term = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[term] == hashes)
        if not len(known):
            return
        s = self.stride
        windows = np.maximum(-(-w.counts // s) - 1, 1)
        base = np.cumsum(windows) - windows
        row, q = w.row[known], (known - w.first[w.row[known]]) // s
        term = term[known]
        first, second = q < windows[row], q > 0
        passage = np.concatenate([(base[row] + q)[first], (base[row] + q - 1)[second]])
        keys = np.unique(passage * len(self.vocabulary) + np.concatenate([term[first], term[second]]))
        found = self.scores(keys // len(self.vocabulary), keys % len(self.vocabulary), int(windows.sum()))
        for p, item, score in zip(*(x.tolist() for x in found)):
            r = int(np.searchsorted(base, p, "right")) - 1
            a = int(w.first[r]) + (p - int(base[r])) * s
            yield r, a, min(a + 2 * s, int(w.first[r + 1])), item, score

    def verify(self, hashes: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the question's n-grams and of the answer's words that a window of words has."""
        question, answer = self.questions[item], self.answers[item]
        return float(np.isin(question, _grams(hashes, self.sizes[item])).mean()), float(np.isin(answer, hashes).mean())


def leaks(indexes: list[Index], column: pa.Array) -> list[list[tuple]]:
    """(item_id, score, question overlap, answer overlap) of the verified items of each text, each id once."""
    out: list[list[tuple]] = [[] for _ in column]
    for start, _, raw, offsets in texts(pc.utf8_lower(column)):
        w = Words(_PLAIN[raw], offsets)
        if not len(w.starts):
            continue
        hashes = w.hashes()
        best: dict[tuple, tuple[float, float, float]] = {}
        for index in indexes:
            for r, a, b, item, score in index.retrieved(w, hashes):
                q_share, a_share = index.verify(hashes[a:b], item)
                if q_share >= OVERLAP and a_share >= OVERLAP:
                    key = (r, index.ids[item])
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q_share, a_share))
        for (r, item_id), x in sorted(best.items(), key=lambda kv: (kv[0][0], kv[0][1] is not None, kv[0][1])):
            out[start + r].append((item_id, *x))
    return out


_OVERLAPS = ("score", "question_overlap", "answer_overlap")


def _leak_type(items: DataFrame) -> T.StructType:
    own = T.LongType() if isinstance(items.schema["item_id"].dataType, T.IntegralType) else T.StringType()
    return T.StructType([T.StructField("item_id", own), *[T.StructField(c, T.DoubleType()) for c in _OVERLAPS]])


def _finder(held, leak: T.StructType):
    own = pa.int64() if isinstance(leak["item_id"].dataType, T.LongType) else pa.string()
    kind = pa.list_(pa.struct([("item_id", own), *[(c, pa.float64()) for c in _OVERLAPS]]))
    names = leak.names

    @F.arrow_udf(T.ArrayType(leak))
    def leaks_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([[dict(zip(names, x)) for x in found] for found in leaks(held.value, column)], kind)

    return leaks_of


def passes(items: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[list[Index]]:
    """The indexes of each shard of the items, one after the other; a shard's text and indexes are all that the driver holds."""
    own = items.select(F.col("item_id").cast(_leak_type(items)["item_id"].dataType).alias("item_id"), "text").filter("text is not null")
    word = F.filter(F.split(F.lower("text"), "[\\x00-\\x20\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), lambda w: w != "")
    own = own.withColumn("_n", F.size(word)).filter("_n > 0")
    n, total, size = own.agg(F.count("*"), F.sum("_n"), F.sum(F.octet_length("text"))).first()
    shards = math.ceil((size or 0) / pass_bytes)
    terms = own.select("item_id", "text", F.explode(F.array_distinct(word)).alias("w"))
    if shards > 1:
        df = cut(terms.groupBy("w").agg(F.count("*").alias("df")), "term-frequencies")
    for k in range(shards):
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k
        by_length: dict[int, list[tuple]] = {}
        for r in own.filter(part).collect():
            by_length.setdefault(math.ceil(math.log(r["_n"], GROWTH)), []).append((r["item_id"], r["text"]))
        frequencies = {}
        if shards > 1:
            counts = df.join(terms.filter(part).select("w").distinct(), "w", "left_semi").collect()
            frequencies = dict(zip(plain_words(pa.array([r["w"] for r in counts], pa.large_string())).hashes().view(np.int64).tolist(), [r["df"] for r in counts])) if counts else {}
        else:
            whole = plain_words(pa.array([t for rows in by_length.values() for _, t in rows], pa.large_string()))
            frequencies = dict(zip(*(x.tolist() for x in np.unique(np.unique(np.column_stack([whole.hashes().view(np.int64), whole.row]), axis=0)[:, 0], return_counts=True))))
        if by_length:
            yield [Index(rows, n, total / n, frequencies) for _, rows in sorted(by_length.items())]


def _leaks_of_texts(docs: DataFrame, items: DataFrame, made: Iterator[list[Index]]) -> DataFrame:
    """(_text, and the fields of a leak) for each different text of docs and item that it has; docs are read once for each of made."""
    leak, sc = _leak_type(items), docs.sparkSession.sparkContext
    rows, parts = docs.select(digest(F.col("text")).alias("_text"), "text"), []
    for indexes in made:
        held = sc.broadcast(indexes)
        found = rows.select("_text", F.inline(_finder(held, leak)(F.col("text"))))
        parts.append(cut(found, "leaks"))
        held.destroy()
    best = reduce(DataFrame.unionByName, parts).groupBy("_text", "item_id").agg(F.max(F.struct(*_OVERLAPS)).alias("x"))
    return cut(best.select("_text", "item_id", "x.*"), "leaks-of-texts")


def _first_two(made: Iterator[list[Index]]) -> tuple[list[Index] | None, Iterator[list[Index]] | None]:
    """The first shard's indexes, and all shards' if there are more."""
    first = next(made, None)
    second = next(made, None)
    if second is None:
        return first, None

    def every() -> Iterator[list[Index]]:
        yield first
        yield second
        yield from made

    return first, every()


def find_leaks(docs: DataFrame, items: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each item that a document has."""
    leak = _leak_type(items)
    rows = docs.select("doc_id", "text")
    only, more = _first_two(passes(items, pass_bytes))
    if only is None:
        return rows.filter("false").select("doc_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in leak])
    if more:
        return rows.select("doc_id", digest(F.col("text")).alias("_text")).join(_leaks_of_texts(docs, items, more), "_text").drop("_text")
    return rows.select("doc_id", F.inline(_finder(docs.sparkSession.sparkContext.broadcast(only), leak)(F.col("text"))))


def without_leaks(docs: DataFrame, items: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs that have no item of the benchmark."""
    only, more = _first_two(passes(items, pass_bytes))
    if only is None:
        return docs
    if more:
        found = cut(_leaks_of_texts(docs, items, more).select(F.col("_text").alias("_leaked")).distinct(), "leaked-texts")
        return docs.join(found, digest(F.col("text")) == F.col("_leaked"), "left_anti")
    return docs.filter(F.size(_finder(docs.sparkSession.sparkContext.broadcast(only), _leak_type(items))(F.col("text"))) == 0)
