"""Decisions remembered by vector: an idempotent table of them, and the nearest ones to each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.operators import vectors

FLOOR, FULL = 0.35, 0.80
MAX_QUERIES = 1000


def decision_key(*parts: Column) -> Column:
    """The same decision has the same key in every run."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def upsert(table: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """table with the rows of new in place of those with their keys."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def calibrate(similarity: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity - FLOOR) / (FULL - FLOOR))), 4)


def compare(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row beside each query: queries are broadcast while they are at most MAX_QUERIES, else dealt to blocks of about
    that many, and tasks compare a block with a part of the rows."""
    if queries.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES:
        return rows.join(F.broadcast(queries), F.lit(True))
    blocks = queries.repartition(-(-queries.count() // MAX_QUERIES))
    return rows.join(blocks.hint("shuffle_replicate_nl"), F.lit(True))


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, similarity, rank) of each query's k nearest rows, for queries (query_id, query); blocks of both are compared as matrices.

    Over a table that is searched again and again, `vectors` keeps an index.
    """
    return vectors.exact(rows, queries, k)
