"""The vector index: exact search against brute force, recall of a partial one, upserts; and the semantic channel."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridmend.operators import mapping, vectors
from gridmend.plans import more_queries
from gridmend.scratch import scratch


def by_hand(rows, queries, k=5):
    unit = lambda v: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))
    out = {}
    for q, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(x)), 6), key) for key, x in rows if x and len(x) == len(v) and any(x))
        out[q] = [(key, -s) for s, key in scored[:k]]
    return out


def test_exact_search_after_upserts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    r = random.Random(3)
    vec = lambda: [r.gauss(0, 1) for _ in range(8)]
    rows = {k: vec() for k in range(150)}
    same = vec()
    rows |= dict.fromkeys(range(200, 260), same)  # a third are copies
    odd = {300: None, 301: [], 302: [0.0] * 8, 303: [1.0] * 3, 304: [math.nan] * 8}
    df = spark.createDataFrame(list((rows | odd).items()), "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    lists, path = vectors.fit(df, lists=7), scratch(spark, "v")
    assert vectors.read(spark, path) is None
    vectors.upsert(path, df, lists)
    assert vectors.read(spark, path).count() == 210
    changed = {k: vec() for k in range(0, 150, 3)} | {1: None, 500: same}
    vectors.upsert(path, spark.createDataFrame(list(changed.items()), "vec_id long, embedding array<double>"), lists)
    vectors.upsert(path, spark.createDataFrame(list(changed.items()), "vec_id long, embedding array<double>"), lists)
    rows |= changed
    index = vectors.read(spark, path)
    assert sorted(x["key"] for x in index.select("key").collect()) == sorted(k for k, v in rows.items() if v)
    queries = [(k, vec()) for k in range(40)] + [(99, same)]
    asked = spark.createDataFrame([*queries, (98, None)], "query_id long, query array<double>")
    want = by_hand(list(rows.items()), queries)
    for found in (vectors.search(index, asked, lists), vectors.exact(spark.createDataFrame(list((rows | odd).items()), "vec_id long, embedding array<double>").orderBy("vec_id"), asked)):
        got = {}
        for x in sorted(found.collect(), key=lambda x: (x["query_id"], x["rank"])):
            got.setdefault(x["query_id"], []).append((x["vec_id"], x["similarity"]))
        assert {q: [k for k, _ in v] for q, v in got.items()} == {q: [k for k, _ in v] for q, v in want.items()}
        assert [k for k, _ in got[99]] == [200, 201, 202, 203, 204]
    empty = df.limit(0)
    assert vectors.search(index, asked.limit(0), lists).count() == 0 and vectors.exact(empty, asked).count() == 0
    vectors.upsert(scratch(spark, "none"), empty, vectors.fit(empty))


def test_recall_of_half_of_the_lists(spark):
    d = "/root/testdata/sf0.1"
    want = {(x["query_id"], x["vec_id"]) for x in more_queries.nearest_decisions(spark, d).collect()}
    got = {(x["query_id"], x["vec_id"]) for x in more_queries.vector_search(spark, d).collect()}
    assert len(want) == 500 and len(want & got) / len(want) >= 0.9
    plan = more_queries.vector_search(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_semantic_channel(spark):
    columns = spark.createDataFrame([("s", 0, "Bldg Repl Cost"), ("s", 1, "Town name"), ("s", 2, "zzz")], "sheet string, column_idx int, header string")
    cells = spark.createDataFrame([("s", c, p, v) for c in range(3) for p, v in enumerate(["500000", "600000", "700001", "800000"] if c == 0 else ["Boston", "Albany", "Austin", "Salem"])], "sheet string, column_idx int, pos int, value string")
    said = {"Building Value": "replacement cost of the building", "City": "name of the city or town"}
    scores = mapping.semantic_scores(columns, said)
    have = {(r["header"], r["target"]): r["semantic"] for r in scores.collect()}
    assert len(have) == 6 and have["Bldg Repl Cost", "Building Value"] > have["Bldg Repl Cost", "City"] and have["zzz", "City"] == 0
    phrases = mapping.glossary_rows()
    plain = {(r["header"], r["target"]): r for r in mapping.build_evidence(columns, cells, phrases, 2026).collect()}
    fused = {(r["header"], r["target"]): r for r in mapping.build_evidence(columns, cells, phrases, 2026, scores).collect()}
    for key, r in fused.items():
        weights = [(r["lexical"], 0.30), (0 if r["abstained"] else r["fingerprint"], 0 if r["abstained"] else 0.35)] + ([(r["semantic"], 0.35)] if r["semantic"] is not None else [])
        assert abs(r["fused"] - sum(x * w for x, w in weights) / sum(w for _, w in weights)) < 1e-4, key
        assert r["semantic"] == have.get(key) and (r["semantic"] is not None or r["fused"] == plain[key]["fused"])

    def absent(texts):
        raise ImportError("no model here")

    for encode in (None, absent):
        none = mapping.semantic_scores(columns, said, encode)
        assert none.filter("semantic is not null").count() == 0 and none.count() == 6
    got = {r["header"]: r for r in mapping.map_columns(mapping.build_evidence(columns, cells, phrases, 2026, scores)).collect()}
    assert got["Bldg Repl Cost"]["target"] == "Building Value" and got["zzz"]["target"] is None
