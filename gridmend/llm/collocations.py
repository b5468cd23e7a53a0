"""Phrase collocations by best-first branch and bound: the phrases of two or three words with the best score, for each language.

Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and 0x0A-0x0D, and those into words at 0x20 and 0x09. With a the count of a phrase,
and l and r those of the two parts of a cut, its score is floor(SCALE * a * a / (l * r)) at the cut where that is least. Phrases of min_count
occurrences are candidates; one drops out if a longer candidate that holds it has at least `share` percent of its occurrences.

Phrases grow to the right. A prefix p = w1 w2 bounds the score of what grows from it: a is at most f(p), and with the cut after w1
l is f(w1) and r at least a, so no score is above floor(SCALE * f(p) / f(w1)). For a prefix of one word the bound is SCALE, so all words of
min_count occurrences are grown. From then on the frontier is the set of two-word prefixes in the order of their bounds. Each round lowers
every unsettled language's threshold, grows all prefixes whose bound reaches it in one pass over the texts, and counts who survives at or
above it; a two-word phrase at or above it needs every longer phrase that begins or ends with it, and those are counted too.
A language is settled once `top` survivors reach the threshold, since nothing that wasn't grown can, or once all prefixes are grown.

Words are 64-bit hashes while they are counted, in numpy arrays within tasks; if two words of the corpus share a hash, all begins again
with another seed. Tasks sum what they have seen before it is shuffled, so a word that is a third of all has a row a task.
Which words and prefixes may grow reaches the tasks as bitmaps of a fixed 2**BITS bits: a bit that is set for another prefix costs
counting one phrase more, and changes no result. Products of counts are decimals of 38 digits: exact below 10**15 occurrences.

Defined results: null and empty texts have no words; documents without a lang are of `und`. Rows count as often as they occur, whatever their doc_id.
Very long texts are counted in stretches that end where pieces do. A lang with fewer phrases than `top` has them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_small
from .textarrays import CHUNK_BYTES, mix, span_hashes, texts

MIN_COUNT, TOP, SHARE, SCALE = 10, 2000, 50, 1_000_000
#: bits of a bitmap, keys that a task holds, candidates aimed at for each one wanted, and how that grows by round
BITS, HELD, FIRST, STEP = 25, 1 << 20, 2, 4
_CUT, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def _stretches(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, starts of rows) of at most about CHUNK_BYTES, cut where pieces end."""
    if len(raw) <= 2 * CHUNK_BYTES:
        yield raw, offsets
        return
    stops = np.union1d(np.flatnonzero(_CUT[raw]) + 1, offsets)
    at = 0
    while at < len(raw):
        end = int(stops[np.searchsorted(stops, min(at + CHUNK_BYTES, len(raw)))])
        yield raw[at:end], offsets[(offsets >= at) & (offsets <= end)] - at
        at = end


class Pieces:
    """The words of a stretch: byte spans, hashes, and whether the next word is in the same piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.raw = raw = _LOWER[raw]
        n = len(raw)
        cuts = _CUT[raw]
        word = ~(cuts | _GAP[raw])
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:n]
        ends[:-1] &= ~word[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        before = np.cumsum(cuts | edge[:n])[self.starts] if n else self.starts
        self.joined = before[1:] == before[:-1]
        self.hashes = span_hashes(table[raw], self.starts, self.ends)

    def words(self, which: np.ndarray) -> pa.Array:
        """The texts of some words."""
        sizes = self.ends[which] - self.starts[which]
        ends = np.append(0, np.cumsum(sizes))
        data = self.raw[np.repeat(self.starts[which] - ends[:-1], sizes) + np.arange(ends[-1])]
        return pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys with equal ones side by side, and where runs of equal ones begin in it; rarely, equal keys make more than one run."""
    code = keys[0]
    for k in keys[1:]:
        code = mix(code) + k
    order = np.argsort(code)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


class Tally:
    """Keys of one to three hashes with their counts, by lang; summed whenever HELD keys are there."""

    def __init__(self, keys: int, with_words: bool = False):
        self.width, self.with_words, self.size, self.held = keys, with_words, 0, {}

    def add(self, lang: str, keys: list[np.ndarray], pieces: Pieces | None = None) -> None:
        if not len(keys[0]):
            return
        order, starts = _groups(keys)
        row = [k[order[starts]] for k in keys] + [np.diff(np.append(starts, len(order)))]
        if self.with_words:
            row.append(pieces.words(order[starts]))
        self.held.setdefault(lang, []).append(row)
        self.size += len(starts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for lang, held in self.held.items():
            columns = [np.concatenate(x) for x in list(zip(*held))[: self.width + 1]]
            order, starts = _groups(columns[: self.width])
            first = order[starts]
            out = [pa.array([lang] * len(starts), pa.string()), *[pa.array(k[first].view(np.int64)) for k in columns[: self.width]], pa.array(np.add.reduceat(columns[self.width][order], starts))]
            names = ["lang", *[f"h{k + 1}" for k in range(self.width)], "n"]
            if self.with_words:
                out.append(pa.concat_arrays([x[-1] for x in held]).take(pa.array(first)).cast(pa.binary()))
                names.append("word")
            yield from pa.Table.from_arrays(out, names=names).to_batches(max_chunksize=50_000)
        self.held, self.size = {}, 0


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    lang = batch.column("lang")
    for name in pc.unique(lang).to_pylist():
        yield name, batch.column("text").filter(pc.equal(lang, name))


def _counter(keys: int, seed: int, pick):
    """A function for mapInArrow from (lang, text) to summed keys; pick(pieces) returns the keys of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        tally = Tally(keys, keys == 1)
        for batch in batches:
            for lang, column in _by_lang(batch):
                for _, _, raw, offsets in texts(column):
                    for part in _stretches(raw, offsets):
                        pieces = Pieces(*part, table)
                        tally.add(lang, pick(pieces), pieces)
                        if tally.size >= HELD:
                            yield from tally.rows()
        yield from tally.rows()

    return run


def _pair_code(a, b):
    """A hash of two hashes that has the same bits in numpy and in Spark (`pair_bit`)."""
    return a ^ ((b << _U(1)) | (b >> _U(63)))


def _bit(code: Column) -> Column:
    return F.shiftrightunsigned(code, 64 - BITS)


def _pair_bit(a: str, b: str) -> Column:
    return _bit(F.col(a).bitwiseXOR(F.shiftleft(b, 1).bitwiseOR(F.shiftrightunsigned(b, 63))))


def bitmap(rows: DataFrame, bit: Column):
    """2**BITS bits as words of 64, with those of rows set; a broadcast of a size that doesn't depend on the rows."""
    words = rows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("w")).toArrow()
    made = np.zeros(1 << (BITS - 6), np.uint64)
    made[words["at"].to_numpy()] = words["w"].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(made)


def _in(found, code: np.ndarray) -> np.ndarray:
    bit = code >> _U(64 - BITS)
    return (found.value[bit >> _U(6)] >> (bit & _U(63))) & _U(1) == 1


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    wide = lambda c: f"cast({c} as decimal(18,0))"
    return F.expr(f"({wide(a)} * {wide(a)} * cast({SCALE} as decimal(7,0))) div ({wide(l)} * {wide(r)})")


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """(lang, h1, word, n) of all words of rows (lang, text)."""
    counted = rows.mapInArrow(_counter(1, seed, lambda p: [p.hashes]), "lang string, h1 long, n long, word binary")
    return counted.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.min("h1").alias("h1"), F.sum("n").alias("n"))


def count_pairs(rows: DataFrame, seed: int, words) -> DataFrame:
    """(lang, h1, h2, n) of pairs of words of which the bitmap has both."""

    def pick(p: Pieces) -> list[np.ndarray]:
        fine = _in(words, p.hashes)
        at = np.flatnonzero(p.joined & fine[:-1] & fine[1:])
        return [p.hashes[at], p.hashes[at + 1]]

    return rows.mapInArrow(_counter(2, seed, pick), "lang string, h1 long, h2 long, n long").groupBy("lang", "h1", "h2").agg(F.sum("n").alias("n"))


def count_triples(rows: DataFrame, seed: int, pairs, prefixes, suffixes) -> DataFrame:
    """(lang, h1, h2, h3, n) of triples of which `pairs` has both pairs, and `prefixes` has the first or `suffixes` the second."""

    def pick(p: Pieces) -> list[np.ndarray]:
        at = np.flatnonzero(p.joined[:-1] & p.joined[1:])  # both joints of three words
        first, second = _pair_code(p.hashes[at], p.hashes[at + 1]), _pair_code(p.hashes[at + 1], p.hashes[at + 2])
        at = at[_in(pairs, first) & _in(pairs, second) & (_in(prefixes, first) | _in(suffixes, second))]
        return [p.hashes[at], p.hashes[at + 1], p.hashes[at + 2]]

    return rows.mapInArrow(_counter(3, seed, pick), "lang string, h1 long, h2 long, h3 long, n long").groupBy("lang", "h1", "h2", "h3").agg(F.sum("n").alias("n"))


def _named(df: DataFrame, **names: str) -> DataFrame:
    return df.select("lang", *[F.col(old).alias(new) for new, old in names.items()])


def _thresholds(ranks: DataFrame, want: DataFrame) -> DataFrame:
    """(lang, least): the score that `want` candidates of a lang reach, from (lang, step, n), a lang's counts by thousandth of SCALE; 0 if there are fewer."""
    down = Window.partitionBy("lang").orderBy(F.col("step").desc())
    reached = ranks.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(want), "lang")
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= F.col("want"), F.col("step") * (SCALE // 1000))), F.lit(0)).alias("least"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, share: int = SHARE, seed: int = 1) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each lang's best phrases."""
    rows = docs.filter("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    while True:
        words = cut(count_words(rows, seed), "words")
        if words.groupBy("lang", "h1").count().filter("count > 1").isEmpty():
            break
        seed += 1
    often = cut(words.filter(F.col("n") >= min_count), "frequent-words")
    pairs = cut(count_pairs(rows, seed, bitmap(often, _bit(F.col("h1")))).filter(F.col("n") >= min_count), "frequent-pairs")
    with_parts = join_small(join_small(_named(pairs, h1="h1", h2="h2", a="n"), _named(often, h1="h1", l="n"), ["lang", "h1"], "inner"), _named(often, h2="h1", r="n"), ["lang", "h2"], "inner")
    two = cut(with_parts.select("*", _score("a", "l", "r").alias("score"), F.expr(f"(cast(a as decimal(18,0)) * {SCALE}) div cast(l as decimal(18,0))").alias("bound")), "pairs")
    ranks = cut(two.groupBy("lang", F.floor(F.col("score") / (SCALE // 1000)).cast("long").alias("step")).agg(F.count("*").alias("n")), "pair-ranks")
    all_pairs, want = bitmap(two, _pair_bit("h1", "h2")), ranks.select("lang").distinct().select("lang", F.lit(FIRST * top).alias("want"))
    while True:
        least = cut(_thresholds(ranks, want), "thresholds")
        reach = join_small(two, least, "lang", "inner")
        grown = bitmap(reach.filter("bound >= least"), _pair_bit("h1", "h2")), bitmap(reach.filter("score >= least"), _pair_bit("h1", "h2"))
        three = cut(count_triples(rows, seed, all_pairs, *grown).filter(F.col("n") >= min_count), "frequent-triples")
        survivors = cut(_survivors(two, three, often, share, least), "survivors")
        have = survivors.groupBy("lang").count().withColumnRenamed("count", "have")
        open_langs = least.join(have, "lang", "left").filter(F.col("least") > 0).filter(F.coalesce("have", F.lit(0)) < top)
        if open_langs.isEmpty():
            break
        want = cut(want.join(open_langs.select("lang", F.lit(True).alias("open")), "lang", "left").select("lang", F.when(F.col("open"), F.col("want") * STEP).otherwise(F.col("want")).alias("want")), "wanted")
    return _best(survivors, words, often, top)


def _survivors(two: DataFrame, three: DataFrame, often: DataFrame, share: int, least: DataFrame) -> DataFrame:
    """(lang, h1, h2, h3, a, l, r, score) of the candidates that reach their lang's threshold and that no longer one holds."""
    key = lambda a, b: ["lang", a, b]
    heads = two.select("lang", "h1", "h2", F.col("a").alias("head"), F.col("l").alias("f1"))
    tails = two.select("lang", F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("tail"), F.col("r").alias("f3"))
    wide = join_small(join_small(_named(three, h1="h1", h2="h2", h3="h3", a="n"), heads, key("h1", "h2"), "inner"), tails, key("h2", "h3"), "inner")
    cuts = wide.withColumns({"s1": _score("a", "f1", "tail"), "s2": _score("a", "head", "f3")})
    early = F.col("s1") <= F.col("s2")
    scored = cuts.select("lang", "h1", "h2", "h3", "a", F.when(early, F.col("f1")).otherwise(F.col("head")).alias("l"), F.when(early, F.col("tail")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    held = _named(three, h1="h1", h2="h2", a="n").unionByName(_named(three, h1="h2", h2="h3", a="n")).groupBy("lang", "h1", "h2").agg(F.max("a").alias("longer"))
    reach = lambda df: join_small(df, least, "lang", "inner").filter("score >= least").drop("least")
    alone = reach(two).join(held, ["lang", "h1", "h2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    return alone.select("lang", "h1", "h2", F.lit(None).cast("long").alias("h3"), "a", "l", "r", "score").unionByName(reach(scored))


def _best(survivors: DataFrame, words: DataFrame, often: DataFrame, top: int) -> DataFrame:
    out = survivors
    for k in (1, 2, 3):
        out = out.join(_named(often, **{f"h{k}": "h1", f"w{k}": "word"}), ["lang", f"h{k}"], "left")
    phrase = out.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = phrase.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
