"""Substring dedup over sliding spans of sentences.

A text is cut into sentences: at a newline and at a word that ends in . ! or ?. A stretch of more than CAP words without either
is also cut before each word whose hash is the least of WINDOW neighbours in the stretch, so the same words are cut alike at any
offset. The runs that are hashed, over their words alone, are

* every window of SENTENCES consecutive sentences that no cut inside a stretch bounds, if it has WINDOW_WORDS words (a line of
  three tiny sentences that many documents share is left alone); and
* from each sentence, and up to each sentence, the shortest run of two sentences or more with at least SPAN_WORDS words.

So any repeated sequence of whole sentences that has as many sentences and words as one of the two asks for is covered by runs inside it, whatever
stands around it. A sentence that is only in part of the passage stays; in a long stretch that is up to 2 * WINDOW - 2 words at
either end.

The first occurrence of a run, by doc_id and then by place, stays; the sentences under any other occurrence go. All bytes outside
them stay as they are: with sentences that make up whole lines go those lines' indentation and one line break each, with others
the white space towards the sentence that follows in the line, or, at a line's end, that before them.

A run is known by two independent hashes of 64 bits: nothing is removed because one of them is shared by chance.

Runs that a document repeats are found as it is read. For the rest only (hashes, document) rows are shuffled: once into a least and a
greatest document per hash, with partial sums, and once more to join the hashes that have two. Those are written first, so that
adaptive execution may split the join where a passage is in a third of all documents. What is then shuffled with the texts is each
document's own list of hashes to remove.

Result: the rows of docs, with text the text that stays, n_chars its length, and n_sentences and n_removed counted in sentences.

Defined results: a null text stays null and an empty one empty, both with no sentences. Rows that share a doc_id count as one
document: none of them loses a run to another. Integer doc_ids are ordered as numbers, others as strings. Rows without a doc_id
come last, in the order of a hash of their texts. Texts of one sentence have no runs. Other columns pass through; ones named like
new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .textarrays import Words, span_hashes, texts

SENTENCES, WINDOW_WORDS, SPAN_WORDS, CAP, WINDOW = 3, 15, 25, 25, 6
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def _cuts(hashes: np.ndarray, begins: np.ndarray, cap: int, window: int = WINDOW) -> np.ndarray:
    """The words of stretches of more than cap words whose hash is the least in a window; the last one wins a tie."""
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(begins)))
    left = np.repeat(starts + lengths, lengths) - np.arange(len(begins))
    at = np.flatnonzero((np.repeat(lengths, lengths) > cap) & (left >= window))
    least = at.copy()
    for k in range(1, window):
        least = np.where(hashes[at + k] <= hashes[least], at + k, least)
    return least


class Sentences:
    """Sentences of a piece of texts and the runs over them, as numbers of words and of sentences."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, sentences: int, window_words: int, span_words: int, cap: int):
        self.words = w = Words(raw, offsets)
        n = len(w.starts)
        lines = np.append(0, np.cumsum(raw == 10))
        line = lines[w.starts] if n else np.zeros(0, np.int64)
        new_line = np.ones(n, bool)
        new_line[1:] = line[1:] != line[:-1]
        new_line[w.first[:-1][w.counts > 0]] = True
        begins = new_line.copy()
        begins[1:] |= _ENDS[raw[w.ends[:-1] - 1]]
        natural = begins.copy()
        hashes = w.hashes() if n else np.zeros(0, np.uint64)
        begins[_cuts(hashes, begins, cap)] = True
        self.starts = np.flatnonzero(begins)
        self.ends = np.append(self.starts[1:], n) if n else self.starts
        self.row = w.row[self.starts]
        self.opens_line = new_line[self.starts]
        k = np.arange(len(self.starts))
        first, last = self._pairs(k, natural, sentences, window_words, span_words)
        same = self.row[first] == self.row[last]
        self.first, self.last = first[same], last[same]
        spans = self.starts[self.first], self.ends[self.last]
        self.hashes, self.seconds = (span_hashes(x, *spans).view(np.int64) if n else np.zeros(0, np.int64) for x in (hashes, w.second_hashes() if n else hashes))
        self.run_row = self.row[self.first]

    def _pairs(self, k: np.ndarray, natural: np.ndarray, sentences: int, window_words: int, span_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) sentence of each run, some of which may leave their texts; k numbers the sentences."""
        n = len(k)
        ahead = np.maximum(np.searchsorted(self.ends, self.starts + span_words), k + 1)
        back = np.minimum(np.searchsorted(self.starts, self.ends - span_words, "right") - 1, k - 1)
        cuts = np.append(0, np.cumsum(~natural[self.starts]))  # cuts inside stretches before each sentence
        window = k[: max(n - sentences + 1, 0)]
        after = np.minimum(window + sentences + 1, n)  # the sentence behind a window bounds it, too
        window = window[(cuts[after] == cuts[window]) & (self.ends[window + sentences - 1] - self.starts[window] >= window_words)]
        first, last = np.concatenate([k, back, window]), np.concatenate([ahead, k, window + sentences - 1])
        fits = (first >= 0) & (last < n)
        pairs = np.unique(first[fits] * np.int64(n) + last[fits])
        return pairs // max(n, 1), pairs % max(n, 1)


def _by_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.append(0, np.cumsum(np.bincount(rows, minlength=n)))


_RUNS = T.ArrayType(T.StructType([T.StructField("h", T.LongType(), False), T.StructField("g", T.LongType(), False)]), False)
_RUNS_ARROW = pa.list_(pa.field("element", pa.struct([pa.field("h", pa.int64(), False), pa.field("g", pa.int64(), False)]), False))


def _hasher(*limits: int):
    @F.arrow_udf(_RUNS)
    def run_hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            made = []
            for _, _, raw, offsets in texts(column):
                s = Sentences(raw, offsets, *limits)
                # each hash once a document
                order = np.lexsort((s.seconds, s.hashes, s.run_row))
                h, g, r = s.hashes[order], s.seconds[order], s.run_row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (r[1:] != r[:-1])
                runs = pa.StructArray.from_arrays([pa.array(h[new]), pa.array(g[new])], fields=list(_RUNS_ARROW.value_type))
                made.append(pa.ListArray.from_arrays(pa.array(_by_row(r[new], len(offsets) - 1), pa.int32()), runs, type=_RUNS_ARROW))
            yield pa.concat_arrays(made) if made else pa.array([], _RUNS_ARROW)

    return run_hashes


def _bytes_gone(raw: np.ndarray, s: Sentences, gone: np.ndarray) -> np.ndarray:
    """Which bytes go with the sentences that are gone."""
    edge = np.zeros(len(raw) + 1, np.int64)
    apart = s.row[1:] != s.row[:-1]
    begins, ends = gone.copy(), gone.copy()
    begins[1:] &= ~gone[:-1] | apart
    ends[:-1] &= ~gone[1:] | apart
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    if len(first):
        w, follows = s.words, np.minimum(last + 1, len(s.starts) - 1)
        opens = s.opens_line[first]
        closes = (follows == last) | (s.row[follows] != s.row[last]) | s.opens_line[follows]
        word_begin, word_end = w.starts[s.starts[first]], w.ends[s.ends[last] - 1]
        line_begins = np.append(0, np.flatnonzero(raw == 10) + 1)
        line_begin = np.maximum(line_begins[np.searchsorted(line_begins, word_begin, "right") - 1], w.offsets[s.row[first]])
        line_end = np.minimum(np.append(line_begins, len(raw))[np.searchsorted(line_begins, word_end, "right")], w.offsets[s.row[last] + 1])
        lo = np.where(opens, np.where(closes, line_begin, word_begin), np.where(closes, w.ends[s.starts[first] - 1], word_begin))
        hi = np.where(closes, np.where(opens, line_end, word_end), w.starts[s.starts[follows]])
        edge[lo] += 1
        np.subtract.at(edge, hi, 1)
    return np.cumsum(edge)[:-1] > 0


def _as_texts(raw: np.ndarray, keep: np.ndarray, offsets: np.ndarray, nulls: pa.Array) -> pa.Array:
    """The texts of the bytes to keep; a null stays null."""
    ends = np.append(0, np.cumsum(keep))[offsets]
    made = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[keep])])
    return pc.if_else(nulls, pa.scalar(None, pa.large_string()), made)


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
_RESULT_ARROW = pa.struct([("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())])


def _remover(*limits: int):
    @F.arrow_udf(_RESULT)
    def without_runs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, removed in batches:
            kept, counts, cuts = [], [], []
            for a, b, raw, offsets in texts(column):
                s = Sentences(raw, offsets, *limits)
                part = removed.slice(a, b - a)
                lengths = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = part.flatten()
                lists, seconds = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                ends = np.append(0, np.cumsum(lengths))
                # all but the first place of each hash in a document, and all places of those to remove
                order = np.lexsort((s.first, s.seconds, s.hashes, s.run_row))
                h, g, r = s.hashes[order], s.seconds[order], s.run_row[order]
                again = np.zeros(len(h), bool)
                again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1]) & (r[1:] == r[:-1]) & (s.first[order][1:] != s.first[order][:-1])
                for row in np.flatnonzero(lengths):
                    x, y = np.searchsorted(r, [row, row + 1])
                    own = slice(ends[row], ends[row + 1])
                    again[x:y] |= np.isin(h[x:y], lists[own]) & np.isin(g[x:y], seconds[own])
                hit = order[again]
                edge = np.zeros(len(s.starts) + 1, np.int64)
                np.add.at(edge, s.first[hit], 1)
                np.add.at(edge, s.last[hit] + 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept.append(_as_texts(raw, ~_bytes_gone(raw, s, gone), offsets, column.slice(a, b - a).is_null()))
                counts.append(np.bincount(s.row, minlength=b - a))
                cuts.append(np.bincount(s.row[gone], minlength=b - a))
            whole = pa.concat_arrays(kept).cast(pa.string()) if kept else pa.array([], pa.string())
            yield pa.StructArray.from_arrays([whole, *[pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (counts, cuts)]], fields=list(_RESULT_ARROW))

    return without_runs


def _document(docs: DataFrame) -> Column:
    """The id that orders documents; without a doc_id one from the text, after all others."""
    doc_id, late = F.col("doc_id"), F.xxhash64("text")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1) - F.shiftrightunsigned(late, 8))
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("\U0010ffff"), F.hex(late)))


def span_dedup(docs: DataFrame, sentences: int = SENTENCES, window_words: int = WINDOW_WORDS, span_words: int = SPAN_WORDS, cap: int = CAP) -> DataFrame:
    """docs without the sentences under any but the first occurrence of a repeated run."""
    limits = (sentences, window_words, span_words, cap)
    rows = docs.drop("_doc", "_removed", "_kept").withColumn("_doc", _document(docs))
    runs = rows.select("_doc", F.inline(_hasher(*limits)(F.col("text"))))
    repeated = runs.groupBy("h", "g").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last")).filter("first != last").drop("last")
    later = runs.join(cut(repeated, "repeated-runs").hint("merge"), ["h", "g"]).filter("_doc != first")
    later = cut(later.groupBy("_doc").agg(F.collect_set(F.struct("h", "g")).alias("_removed")), "runs-to-remove")
    joined = rows.join(later.hint("shuffle_hash"), "_doc", "left")
    out = joined.withColumn("_kept", _remover(*limits)(F.col("text"), F.col("_removed")))
    new = {"text": F.col("_kept")["text"], "n_chars": F.length(F.col("_kept")["text"]).cast("long"), "n_sentences": F.col("_kept")["n_sentences"], "n_removed": F.col("_kept")["n_removed"]}
    return out.withColumns(new).drop("_doc", "_removed", "_kept")
