"""Similarity self-join of texts by the Jaccard index of their sets of word n-grams, found by MinHash bands.

1. Equal texts are one class from the start: everything below works on one row per different text.
2. Each text gets `bands` hashes of `rows` MinHash values each; `plan_bands` picks both so that a pair at the threshold
   shares a band with the asked recall. Band hashes are shuffled into buckets. Buckets of one text go, and of buckets with the
   same texts in them one stays, as near copies share most of their bands.
3. The sets of n-gram hashes of texts that share a bucket are computed once each and sent to their buckets; a bucket of more
   than BLOCK texts is split into blocks, and each pair of blocks is a task's group of its own, so no task holds more than two
   blocks, and pairs live only as entries of a matrix there. A pair is verified on its full sets in the first bucket that it
   shares and skipped in the others; texts that share no bucket are never compared. A group returns, per text with links, how
   many there are and the least text that it is tied to.
4. Ties between texts are closed by connected components over the returned rows.

Result: the rows of docs with class_id (the least doc_id of all texts linked to it, directly or through others), n_links (how
many different texts are at least as similar as the threshold) and n_copies (rows with the same text, this one included).

Defined results: a text without words (null, empty or white space) is its own class with class_id = doc_id, no links and
n_copies 1. A text of fewer words than n has one n-gram, all of it. Null doc_ids count for a class_id only if the class has no
other. Repeated rows each get a row. Other columns pass through; ones named like the new ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, digest, remove
from .components import connected
from .textarrays import Words, mix, shingles, texts

N, THRESHOLD, RECALL = 5, (4, 5), 0.9995
MAX_HASHES, BLOCK = 128, 128
#: Columns of a matrix of sets at once; pairs that are few enough to be compared one by one.
_COLUMNS, _FEW = 1 << 12, 500
_U = np.uint64


def plan_bands(threshold: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, which let the fewest unlike pairs through, at which enough bands for the recall fit."""
    best = (max_hashes, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def _signer(n: int, bands: int, rows: int):
    seeds = np.random.default_rng(7).integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64)

    @F.arrow_udf(T.ArrayType(T.LongType(), False))
    def band_hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            made = []
            for _, _, raw, offsets in texts(column):
                hashes, row = shingles(Words(raw, offsets), n)
                counts = np.bincount(row, minlength=len(offsets) - 1)
                full = np.flatnonzero(counts)
                out = np.zeros((bands, len(full)), np.uint64)
                starts = (np.cumsum(counts) - counts)[full]
                for k in range(bands * rows if len(full) else 0):
                    least = np.minimum.reduceat(((hashes ^ seeds[0, k]) * (seeds[1, k] | _U(1))) >> _U(32), starts)
                    out[k // rows] = mix(out[k // rows] + least + _U(k))
                ends = np.append(0, np.cumsum(np.where(counts > 0, bands, 0)))
                made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.T.ravel().view(np.int64))))
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int64()))

    return band_hashes


def _in_common(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many values sets[rows[i]] and sets[cols[j]] share, for the wanted entries at least, as a matrix."""
    common = np.zeros(wanted.shape, np.float32)
    at = np.argwhere(wanted)
    if len(at) <= _FEW:
        for i, j in at:
            common[i, j] = len(np.intersect1d(sets[rows[i]], sets[cols[j]], assume_unique=True))
        return common
    i, j = wanted.any(axis=1), wanted.any(axis=0)
    used = np.unique(np.concatenate([rows[i], cols[j]]))
    left, right = np.searchsorted(used, rows[i]), np.searchsorted(used, cols[j])
    values, column = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])[shared[column]]
    column = place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    part = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [k, k + _COLUMNS])
        has = np.zeros((len(used), _COLUMNS), np.float32)
        has[owner[a:b], column[a:b] - k] = 1
        part += has[left] @ has[right].T
    common[np.ix_(i, j)] = part
    return common


def similar(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, wanted: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Which of the wanted pairs of sets[rows[i]] and sets[cols[j]] are at least as similar as the threshold, as a matrix."""
    common = _in_common(sets, rows, cols, wanted).astype(np.int64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    union = sizes[rows][:, None] + sizes[cols][None, :] - common
    return wanted & (common * threshold[1] >= union * threshold[0]) & (union > 0)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric matrix reaches."""
    labels = np.arange(len(linked))
    if not linked.any():
        return labels
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, labels[None, :], len(labels)).min(axis=1)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


_SETS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("grams", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.StructType([T.StructField("band", T.LongType()), T.StructField("blocks", T.LongType())])))])
_VERIFIED = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("root", T.BinaryType()), T.StructField("n_links", T.LongType())])


def _set_maker(n: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sorted n-gram hashes of each different text; repeats of a text within the task are passed over."""
        known: set[bytes] = set()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            new = [k for k, key in enumerate(keys) if key not in known and not known.add(key)]
            batch = batch.take(pa.array(new, pa.int64()))
            for a, b, raw, offsets in texts(batch.column("text")):
                hashes, row = shingles(Words(raw, offsets), n)
                ends = np.searchsorted(row, np.arange(len(offsets)))
                grams = [np.unique(hashes[x:y]).tobytes() for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array(grams, pa.binary()), batch.column("buckets").slice(a, b - a)], names=_SETS.names)

    return make


def _verifier(threshold: tuple[int, int]):
    def group(band: int, bi: int, bj: int, rows: dict[bytes, tuple]) -> tuple[list, list, list]:
        keys = sorted(rows)
        blocks = np.array([rows[k][0] for k in keys])
        sets = [np.frombuffer(rows[k][1], np.uint64) for k in keys]
        earlier: dict[int, list[int]] = {}
        for r, k in enumerate(keys):
            for b in rows[k][2]:
                if b["band"] < band:
                    earlier.setdefault(b["band"], []).append(r)
        wanted = np.ones((len(keys), len(keys)), bool)
        for known in earlier.values():
            if len(known) > 1:
                wanted[np.ix_(known, known)] = False
        np.fill_diagonal(wanted, False)
        left, right = np.flatnonzero(blocks == bi), np.flatnonzero(blocks == bj)
        wanted = wanted[np.ix_(left, right)]
        if bi == bj:
            wanted &= left[:, None] < right[None, :]
        linked = np.zeros((len(keys), len(keys)), bool)
        if wanted.any():
            linked[np.ix_(left, right)] = similar(sets, left, right, wanted, threshold)
        linked |= linked.T
        n_links = linked.sum(axis=1)
        tied = np.flatnonzero(n_links)
        roots = _roots(linked)
        return [keys[r] for r in tied], [keys[roots[r]] for r in tied], n_links[tied].tolist()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        own: tuple[int, int, int] | None = None
        out: tuple[list, ...] = ([], [], [])

        def settle() -> None:
            if len(held) > 1:
                for to, new in zip(out, group(*own, held)):
                    to.extend(new)
            held.clear()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.binary(), pa.int64()))], names=_VERIFIED.names)
            for x in out:
                x.clear()
            return made

        for batch in batches:
            for row in batch.to_pylist():
                if own != (now := (row["band"], row["bi"], row["bj"])):
                    settle()
                    own = now
                held[row["key"]] = (row["block"], row["grams"], row["buckets"])
            if len(out[0]) > 5000:
                yield flush()
        settle()
        yield flush()

    return verify


def _placed(uniq: DataFrame) -> DataFrame:
    """(key, rep, buckets): the texts that share a bucket with others, each with its buckets and the blocks they're split into."""
    # 64 bits name a text while candidates are gathered: a clash can only add candidates, which are verified in full
    buckets = uniq.select(F.xxhash64("key").alias("node"), F.explode("bands").alias("band"))
    members = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"m{seed}") for seed in (1, 2)]
    shared = buckets.groupBy("band").agg(F.count("*").alias("n"), *members).filter("n > 1")
    kept = cut(shared.groupBy("n", "m1", "m2").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), "buckets")
    by_text = buckets.join(kept, "band").groupBy("node").agg(F.collect_list(F.struct("band", "blocks")).alias("buckets"))
    made = cut(uniq.select("key", "rep", F.xxhash64("key").alias("node")).join(by_text, "node").drop("node"), "placed")
    remove(kept)
    return made


def _links(docs: DataFrame, placed: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """(key, root, n_links): in each group of texts, the texts with links and the least text that each is tied to."""
    own = docs.select("doc_id", "text", digest(F.col("text")).alias("_key"))
    # always by shuffle: how many texts have candidates isn't bounded
    found = own.join(placed.hint("shuffle_hash"), (F.col("key") == F.col("_key")) & F.col("rep").eqNullSafe(F.col("doc_id"))).select("key", "text", "buckets")
    sets = found.mapInArrow(_set_maker(n), _SETS)
    dealt = sets.select("*", F.inline("buckets")).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", "blocks")
    dealt = dealt.repartition("band", "bi", "bj").sortWithinPartitions("band", "bi", "bj")
    made = cut(dealt.mapInArrow(_verifier(threshold), _VERIFIED), "verified")
    remove(placed)
    return made


def _text_classes(docs: DataFrame, n: int, threshold: tuple[int, int], recall: float) -> DataFrame:
    """(key, rep, n_links, n_copies, class_id, first): a row for each different text that has words; first: it stands for its class."""
    bands, rows = plan_bands(threshold[0] / threshold[1], recall)
    keyed = docs.select("doc_id", digest(F.col("text")).alias("key"), _signer(n, bands, rows)(F.col("text")).alias("bands"))
    uniq = cut(keyed.filter(F.size("bands") > 0).groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")), "bands")
    verified = _links(docs, _placed(uniq), n, threshold)
    ties = connected(verified.select("key", F.col("root").alias("tied")), "key", "tied").withColumnRenamed("node", "key")
    counts = verified.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    labels = counts.join(ties, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "n_links")
    out = uniq.select("key", "rep", "n_copies").join(labels, "key", "left")
    out = cut(out.select("key", "rep", "n_copies", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "labels")
    remove(verified)
    remove(uniq)
    # partial sums: a class that a third of all texts belong to is a row a task
    order = F.struct(F.col("rep").isNull(), F.col("rep"), F.col("key"))
    ids = cut(out.filter("n_links > 0").groupBy("root").agg(F.min("rep").alias("class_id"), F.min_by("key", order).alias("first_key")), "classes")
    out = out.join(ids, "root", "left")
    alone = F.col("first_key").isNull()
    return out.select("key", "rep", "n_links", "n_copies", F.when(alone, F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("first_key") == F.col("key"))).alias("first"))


_NEW = ["class_id", "n_links", "n_copies"]


def _joined(docs: DataFrame, n: int, threshold: tuple[int, int], recall: float) -> DataFrame:
    """docs with _class: the fields of its text's class, null without words."""
    classes = _text_classes(docs.select("doc_id", "text"), n, threshold, recall).select(F.col("key").alias("_class_key"), F.struct("*").alias("_class"))
    rows = docs.drop("_key", "_class_key", "_class").withColumn("_key", digest(F.col("text")))
    return rows.join(classes, F.col("_key") == F.col("_class_key"), "left").drop("_key", "_class_key")


def ngram_join(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with class_id, n_links and n_copies."""
    c = F.col("_class")
    filled = {"class_id": F.when(c.isNull(), F.col("doc_id")).otherwise(c["class_id"]), "n_links": F.coalesce(c["n_links"], F.lit(0).cast("long")), "n_copies": F.coalesce(c["n_copies"], F.lit(1).cast("long"))}
    return _joined(docs.drop(*_NEW), n, threshold, recall).withColumns(filled).drop("_class")


def one_per_class(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class: that of its least doc_id, null ids last, or of its least text if they tie; each row without words."""
    c = F.col("_class")
    joined = _joined(docs, n, threshold, recall).filter(c.isNull() | (c["first"] & c["rep"].eqNullSafe(F.col("doc_id"))))
    kept = joined.withColumn("_text_key", c["key"]).drop("_class")
    if kept.groupBy("_text_key").agg(F.count("*").alias("n")).filter("_text_key is not null and n > 1").isEmpty():
        return kept.drop("_text_key")
    # rows that repeat an id and a text: any one of them stays
    worded = kept.filter("_text_key is not null").dropDuplicates(["_text_key"])
    return worded.unionByName(kept.filter("_text_key is null")).drop("_text_key")
