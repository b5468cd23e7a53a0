"""Steps whose cost has to grow no faster than their input: how work is dealt and compiled, read off plans and partitions."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridmend.functions.clean import strip
from gridmend.operators import mapping as M
from gridmend.operators import profile, rules, vectors
from gridmend.plans import by_file, registry
from gridmend.plans.fixture import frame


def test_findings_are_made_by_compiled_code(spark, small):
    plan = rules.run_rules(frame(spark, small), 2026, ["DQ-01", "DQ-05", "DQ-12"], reconciled=True)._jdf.queryExecution().optimizedPlan().toString()
    generate = [x for x in plan.splitlines() if "Generate explode" in x]
    assert generate and not any("CASE WHEN" in x for x in generate)  # a filter of an array works out what it holds without compiled code


def test_workbooks_are_written_and_read_by_all_cores(spark, small):
    assert by_file.typed_workbooks(spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_meet_the_glossary_on_all_cores(spark):
    texts = spark.createDataFrame([(f"bldg valu {k}",) for k in range(50)] + [("bulding value",)], "value string")
    found = M.match_target(texts, M.glossary_rows())
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert ("bulding value", "Building Value") in [tuple(r) for r in found.collect()]


def test_vectors_are_multiplied_in_slices(spark):
    n, width, k = 2 * vectors.SLICE + 1, 4, 3
    x = np.random.default_rng(3).normal(size=(n, width)).astype(np.float32)
    block = pa.array([[{"id": i, "v": v.tolist()} for i, v in enumerate(x)]], pa.list_(pa.struct([("id", pa.int64()), ("v", pa.list_(pa.float32()))])))
    out = list(vectors._multiply(width, k)(iter([pa.RecordBatch.from_arrays([block, block], names=["queries", "rows"])])))
    assert max(b.num_rows for b in out) <= vectors.SLICE * k
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    best = np.argsort(-np.round(unit @ unit.T, 6), axis=1, kind="stable")[:, :k]
    assert [tuple(r.values())[:2] for b in out for r in b.to_pylist()] == [(i, j) for i in range(n) for j in best[i]]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:5])], "vec_id long, embedding array<float>")
    vectors.exact(rows, rows.selectExpr("vec_id as query_id", "embedding as query"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= vectors.BATCH_BYTES


def test_each_different_text_of_a_column_is_classified_once(spark, small):
    odd = [None, "", " \u00a0", "N/A", "tbd ", "Unknown", "-", "TX", "tx ", "\u212a", "O\u212a", "ok", "1,200.00", "(5)", "-5", "1990", "02110", "2110", "Yes", " yes", "12 Main St", "12 x", "Boston", "boston ", "A-1", "1.", ",", ".", "K1A 0B1", "\u00e9", "see #1"]
    kinds = [None, "text", "number", "date", "boolean"]
    rows = [(c, k, v, t) for k, (c, v, t) in enumerate((c, v, t) for _ in range(3) for c in ("a", "b") for v in odd for t in kinds)]
    cells = spark.createDataFrame(rows, "column string, pos int, value string, type string")
    for df, kind in ((cells, F.col("type")), (cells.drop("type"), None)):
        plain = df.select("column", profile.classify_value(F.col("value"), 2026, kind).alias("shape"), F.lower(strip(F.col("value"))).alias("v"), "pos").filter("shape is not null").collect()
        n, first = Counter(tuple(r[:3]) for r in plain), {}
        for r in plain:
            first[tuple(r[:3])] = min(r["pos"], first.get(tuple(r[:3]), r["pos"]))
        shaped = profile._shaped(df, 2026)
        got = {tuple(r[:3]): tuple(r[3:]) for r in shaped.collect()}
        assert got == {k: (n[k], first[k]) for k in n} and len(got) > 40
        plan = shaped._jdf.queryExecution().optimizedPlan().toString()
        above, _, below = plan.rpartition("Aggregate [")
        assert "RLIKE" in above and "RLIKE" not in below and plan.count("RLIKE") < 20
    plan = registry.queries()["classify_value"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("RLIKE") < 20
