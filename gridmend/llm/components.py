"""Connected components of a graph given as a DataFrame of edges, by alternating large and small stars.

Each round links every node's larger neighbours, then its smaller ones, to the least node that it knows; rounds grow as the
logarithm of the longest path. Labels and edges stay in DataFrames; the driver sees one count and one checksum a round.

A node that very many others know, such as the root of a large component, is dealt into parts by its neighbours: each part has
its own copy of the least node, so its edges are no one task's work. A node with few neighbours has as few parts. There are PARTS of them, or
more where the graph has more than PARTS * PART_EDGES edges, so that a part has at most about PART_EDGES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove

PARTS, PART_EDGES = 64, 500_000


def _with_least(edges: DataFrame, least: DataFrame, parts: int) -> DataFrame:
    """edges (hi, lo) with the m of least (hi, m)."""
    part = F.pmod(F.xxhash64("lo"), F.lit(parts)).alias("part")
    dealt = edges.select("hi", "lo", part)
    copies = dealt.select("hi", "part").distinct().join(least, "hi")
    return dealt.join(copies, ["hi", "part"]).select("hi", "lo", "m")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of an edge other than the least of its component, which is the root."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    now = cut(edges.filter(F.col(a) != F.col(b)).select(hi.alias("hi"), lo.alias("lo")).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if seen[0] == 0 or state == tuple(seen):
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = tuple(seen)
        parts = max(PARTS, 2 * seen[0] // PART_EDGES)
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = _with_least(both.filter("lo > hi"), least, parts).filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rest = _with_least(large, small, parts).filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        done, now = now, cut(rest.unionByName(small.withColumnRenamed("m", "lo")).distinct(), "edges")
        remove(done)
