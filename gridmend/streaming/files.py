"""Rules across rows over a stream: files arrive in pieces, and each is judged as a whole once all its rows are there.

A stream has the rows of frames with FILE, and beside them a mark a file: a row with its number of rows in `n_rows`, which schedule rows have as
null. Pieces and marks may come in any order. Rows are kept in a table by micro-batch; what is carried from batch to batch is a row an open file: rows
seen, rows announced, and the batches that have some. No file is one task's group, and a batch reads only those earlier batches that hold rows of
files it completes. All a batch writes lies at a place of its own number, or of its parity, so that a batch that is run again changes nothing.

Rows without a file can't become complete: they are kept and not judged. A file of 0 rows is complete at once and has no findings. More
rows than announced complete a file, too; what comes for a file after that counts as a new file of that key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.operators import rules
from gridmend.operators.frame import FILE
from gridmend.scratch import written

MARK = "n_rows"
_STATE = f"{FILE} string, seen long, announced long, batches array<long>"


def judge_files(stream: DataFrame, year: int, folder: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Takes all that has arrived, and writes work of each complete file below folder; by default all findings of the rules, reconciled.

    work gets a frame of many files and returns rows with FILE. `judged` reads what it gave, `pending` the files that lack rows or a mark.
    """
    work = work or (lambda df: rules.run_rules(df, year, reconciled=True))

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.filter(F.col(MARK).isNull()).drop(MARK).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        rows = spark.read.schema(df.drop(MARK).schema.add("batch", "long")).parquet(f"{folder}/rows")
        came = F.count_if(F.col(MARK).isNull())
        now = df.filter(F.col(FILE).isNotNull()).groupBy(FILE).agg(came.alias("seen"), F.max(MARK).alias("announced"), F.when(came > 0, F.array(F.lit(number).cast("long"))).otherwise(F.array().cast("array<long>")).alias("batches"))
        if number:
            now = now.unionByName(spark.read.schema(_STATE).parquet(f"{folder}/open/{(number - 1) % 2}"))
        whole = now.groupBy(FILE).agg(F.sum("seen").alias("seen"), F.max("announced").alias("announced"), F.array_distinct(F.flatten(F.collect_list("batches"))).alias("batches"))
        known = written(whole.withColumn("complete", F.coalesce(F.col("seen") >= F.col("announced"), F.lit(False))), "files")
        known.filter(~F.col("complete")).drop("complete").write.mode("overwrite").parquet(f"{folder}/open/{number % 2}")
        parts = written(known.filter("complete").select(FILE, F.explode("batches").alias("batch")), "parts")
        numbers = [r["batch"] for r in parts.select("batch").distinct().collect()]  # one integer a micro-batch
        ready = rows.filter(F.col("batch").isin(numbers)).join(parts, [FILE, "batch"], "left_semi").drop("batch")
        work(written(ready, "ready")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{folder}/last")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """What the work gave of all complete files so far."""
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").drop("batch")


def pending(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, seen, announced) of the files that aren't complete; announced is null until the mark has come."""
    number = spark.read.schema("number long").parquet(f"{folder}/last").first()["number"]
    return spark.read.schema(_STATE).parquet(f"{folder}/open/{number % 2}").drop("batches")
