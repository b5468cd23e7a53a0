"""A vector index: inverted lists around centroids that are fitted on a bounded sample, over every row of a table that is kept by key.

Vectors are scaled to length 1, so the product of two is their cosine. Each row is in the list of its nearest centroid; a query reads the `probes`
lists nearest to it, or all of them, which makes the search exact. Rows of a list are packed into blocks of at most about BLOCK rows, queries
of a list likewise; a task multiplies a block of rows with a block of queries as matrices and passes on `k` rows a query. So no row
is paired with a query in a table, however full a list is, and what is shuffled is blocks, then k candidates for each query and block.

The table is partitioned by a hash of the key, and `upsert` rewrites the partitions of the keys that it gets and no others; a row's list is a column,
so a row that moves to another list leaves nothing behind. The centroids are a table beside it.

Defined results: rows without a vector, with one of other length than the first row's, or of length 0, are in no list and found by none. Of rows that share a
key in one upsert the one with the greatest vector stays. Ties in similarity, rounded to 6 places, go to the lower key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmend.scratch import written

#: Lists at most; rows of the sample for each of them; rounds of fitting; partitions by key; rows or queries of a block
MAX_LISTS, SAMPLE_PER_LIST, ROUNDS, KEY_PARTS, BLOCK = 1024, 64, 8, 64, 2048
#: Queries of a block that are multiplied at once, and bytes of blocks that reach a task's Python at once: about four pairs
SLICE, BATCH_BYTES = 256, 4 << 20


@dataclass(frozen=True)
class Lists:
    """The centroids, a row each."""

    centroids: np.ndarray

    @property
    def width(self) -> int:
        return self.centroids.shape[1]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, seed: int = 7) -> Lists:
    """Centroids by spherical k-means on a sample of at most about SAMPLE_PER_LIST rows a list, chosen by a hash of the key.

    There are as many lists as the root of the number of rows, MAX_LISTS at most. The sample is all that reaches the driver.
    """
    own = rows.select(key, vector).filter(F.size(vector) > 0)
    n = own.count()
    if not n:
        return Lists(np.zeros((1, 0)))
    lists = max(1, min(lists or int(n**0.5), MAX_LISTS, n))
    share = min(1.0, lists * SAMPLE_PER_LIST / n)
    taken = own.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)) if share < 1 else own
    found = [r[vector] for r in taken.orderBy(key).select(vector).collect()]
    if not found:
        found = [own.first()[vector]]
    width = len(found[0])
    sample = np.array([v for v in found if len(v) == width and not any(x is None for x in v)], np.float64)
    sample = _unit(sample[np.linalg.norm(sample, axis=1) > 0]) if len(sample) else np.zeros((0, width))
    if not len(sample):
        return Lists(np.zeros((1, width)))
    order = np.random.default_rng(seed).permutation(len(sample))
    centroids = sample[order[:lists]].copy()
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        some = np.linalg.norm(sums, axis=1) > 0
        centroids[some] = _unit(sums[some])
    return Lists(centroids)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a usable vector, those vectors at length 1)."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fine = sizes == width
    if not fine.any() or not width:
        return np.zeros(len(column), bool), np.zeros((0, width))
    flat = column.filter(pa.array(fine)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    usable = np.isfinite(flat).all(axis=1) & (np.abs(flat).sum(axis=1) > 0)
    fine[np.flatnonzero(fine)[~usable]] = False
    return fine, _unit(flat[usable])


def _assigner(held, probes: int):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def nearest_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        centroids = held.value.centroids
        k = min(probes, len(centroids))
        for column in batches:
            fine, unit = _matrix(column, centroids.shape[1])
            product = unit @ centroids.T
            best = np.argpartition(-product, k - 1, axis=1)[:, :k] if k < len(centroids) else np.tile(np.arange(len(centroids)), (len(unit), 1))
            ends = np.append(0, np.cumsum(fine * best.shape[1])) if len(unit) else np.zeros(len(column) + 1, np.int64)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(best.ravel(), pa.int32()))

    return nearest_lists


def assign(rows: DataFrame, lists: Lists, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector, list) of every row with a usable vector."""
    held = rows.sparkSession.sparkContext.broadcast(lists)
    return rows.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"), F.explode(_assigner(held, 1)(F.col(vector).cast("array<float>"))).alias("list"))


def upsert(table: str, rows: DataFrame, lists: Lists, key: str = "vec_id", vector: str = "embedding") -> None:
    """Puts rows into the table at that path, in place of those with their keys; only partitions of their keys are written."""
    spark = rows.sparkSession
    one = assign(rows, lists, key, vector).groupBy("key").agg(F.max(F.struct("vector", "list")).alias("x")).select("key", "x.*")
    part = F.pmod(F.xxhash64("key"), F.lit(KEY_PARTS)).cast("int")
    fresh = written(one.withColumn("part", part), "vectors")
    given = written(rows.select(F.col(key).alias("key")).filter("key is not null").distinct().withColumn("part", part), "given-keys")
    if (old := read(spark, table, given)) is not None:
        touched = old.join(F.broadcast(given.select("part").distinct()), "part", "left_semi")  # KEY_PARTS rows at most
        fresh = written(fresh.unionByName(touched.join(given.select("key"), "key", "left_anti")), "merged-vectors")
        # a partition that loses its only rows is written without any
    parts = [r["part"] for r in given.select("part").distinct().collect()]
    fresh.repartition("part").sortWithinPartitions("part", "list", "key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table)
    left = {r["part"] for r in fresh.select("part").distinct().collect()}
    for p in set(parts) - left:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/part={p}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, table: str, like: DataFrame | None = None) -> DataFrame | None:
    """(key, vector, list, part) of the table, or None if there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    kind = like.schema["key"].dataType.simpleString() if like is not None else "bigint"
    return spark.read.schema(f"key {kind}, vector array<float>, list int, part int").parquet(table)


def _packed(rows: DataFrame, id_: str, vector: str, per: str) -> DataFrame:
    """(list, ids, vectors): the rows of each list in blocks of about BLOCK; the sizes of lists are a small table."""
    sizes = written(rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks")), f"{per}-sizes")
    dealt = rows.join(F.broadcast(sizes), "list").withColumn("_block", F.pmod(F.xxhash64(F.col(id_)), F.col("_blocks")))  # a row a list: MAX_LISTS at most
    return dealt.groupBy("list", "_block").agg(F.collect_list(F.struct(F.col(id_).alias("id"), F.col(vector).alias("v"))).alias(per)).drop("_block")


def _multiply(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                sides = []
                for side in ("queries", "rows"):
                    own = batch.column(side)[n].values
                    fine, unit = _matrix(own.field("v"), width)
                    sides.append((own.field("id").filter(pa.array(fine)), unit))
                (q_ids, q), (r_ids, r) = sides
                ids = r_ids.to_numpy(zero_copy_only=False)
                for start in range(0, len(q), SLICE):
                    scores = np.round(q[start : start + SLICE] @ r.T, 6)
                    top = [np.lexsort((ids, -row))[:k] if len(row) <= 4 * k else _top(row, ids, k) for row in scores]
                    at = np.concatenate(top)
                    which = np.repeat(np.arange(len(scores)), [len(x) for x in top])
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(start + which)), r_ids.take(pa.array(at)), pa.array(scores[which, at].astype(np.float64))], names=["query_id", "vec_id", "similarity"])

    return run


def _top(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k best of a row of scores; all that tie with the last one are ranked by id."""
    least = -np.partition(-row, k - 1)[k - 1]
    near = np.flatnonzero(row >= least)
    return near[np.lexsort((ids[near], -row[near]))[:k]]


def _ranked(rows: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """The k best rows (key, vector, list) of each query (query_id, query, list), of those in one of its lists.

    A pair of blocks is a row of about a MB. Batches are bounded by bytes, so what a worker holds doesn't grow with the table.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    blocks = _packed(rows, "key", "vector", "rows").join(_packed(queries, "query_id", "query", "queries"), "list")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {rows.schema['key'].dataType.simpleString()}, similarity double"
    found = blocks.select("queries", "rows").mapInArrow(_multiply(width, k), kinds)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)  # each task passes on k a query at most


def exact(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """As `search` over all rows, without an index."""
    first = rows.select(vector).filter(F.size(vector) > 0).first()
    own = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"), F.lit(0).alias("list"))
    return _ranked(own, queries.select("query_id", F.col("query").cast("array<float>").alias("query"), F.lit(0).alias("list")), len(first[0]) if first else 0, k)


def search(index: DataFrame, queries: DataFrame, lists: Lists, k: int = 5, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank) of the k rows nearest to each query (query_id, query); probes None reads all lists, and is exact."""
    held = index.sparkSession.sparkContext.broadcast(lists)
    wanted = queries.select("query_id", F.col("query").cast("array<float>").alias("query"))
    wanted = wanted.withColumn("list", F.explode(_assigner(held, probes or len(lists.centroids))(F.col("query"))))
    return _ranked(index.select("key", "vector", "list"), wanted, lists.width, k)
