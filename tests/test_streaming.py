"""Files that arrive in pieces give what they give as whole tables."""

import pytest
from pyspark.sql import functions as F

from gridmend.operators import rules
from gridmend.operators.frame import FILE
from gridmend.plans.fixture import frame
from gridmend.scratch import scratch
from gridmend.streaming import files

YEAR, COLS = 2026, [FILE, "rule", "sheet_row", "field", "severity", "before", "after", "op"]


def rows_of(df):
    return sorted([tuple(r[c] for c in COLS) for r in df.collect()], key=repr)


def pieces(spark, small):
    """A big file and two small ones, a file with no mark, one of no rows, and rows of no file; each row is in one of three pieces."""
    n = F.col("sheet_row")
    name = F.when(n % 3 == 0, "big").when(n % 10 == 1, "late").when(n % 10 == 2, "unmarked").when(n % 10 == 4, None).otherwise("other")
    whole = frame(spark, small).withColumn(FILE, name)
    return whole, [whole.filter((n % 7) % 3 == k).withColumn(files.MARK, F.lit(None).cast("long")) for k in range(3)]


def with_marks(spark, piece, marks):
    made = spark.createDataFrame(marks, f"{FILE} string, {files.MARK} long")
    return piece.unionByName(made, allowMissingColumns=True)


def test_files_in_pieces(spark, small):
    whole, parts = pieces(spark, small)
    counts = {r[FILE]: r["count"] for r in whole.groupBy(FILE).count().collect()}
    landing, folder, checkpoint = (scratch(spark, x) for x in ("landing", "judged", "offsets"))
    schema = parts[0].schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{landing}/*")
    calls = []

    def judge(work=None):
        files.judge_files(stream(), YEAR, folder, checkpoint, work)

    with_marks(spark, parts[0], [("big", counts["big"]), ("none", 0)]).write.parquet(f"{landing}/0")
    judge()
    assert files.judged(spark, folder).count() == 0
    assert {r[FILE]: (r["announced"]) for r in files.pending(spark, folder).collect()} == {"big": counts["big"], "late": None, "other": None, "unmarked": None}
    with_marks(spark, parts[1], [("other", counts["other"])]).write.parquet(f"{landing}/1")
    judge()
    assert files.judged(spark, folder).count() == 0
    with_marks(spark, parts[2], []).write.parquet(f"{landing}/2")

    def fails(df):
        calls.append(1)
        raise RuntimeError("executor lost")

    with pytest.raises(Exception, match="executor lost"):
        judge(fails)
    judge()  # the same batch again
    assert calls and {r[FILE] for r in files.judged(spark, folder).select(FILE).distinct().collect()} == {"big", "other"}
    with_marks(spark, parts[0].limit(0), [("late", counts["late"])]).write.parquet(f"{landing}/3")
    judge()
    judge()
    assert {r[FILE]: r["seen"] for r in files.pending(spark, folder).collect()} == {"unmarked": counts["unmarked"]}
    for name in ("big", "other", "late"):
        alone = rules.run_rules(whole.filter(F.col(FILE) == name), YEAR, reconciled=True)
        assert rows_of(files.judged(spark, folder).filter(F.col(FILE) == name)) == rows_of(alone), name
    assert {x[1] for x in rows_of(files.judged(spark, folder))} >= {"DQ-12", "DQ-13", "DQ-17"} & {x[1] for x in rows_of(rules.run_rules(whole.filter(F.col(FILE) == "big"), YEAR))}
