"""Session, scratch-folder and column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend import scratch

#: Rows that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


#: What one Arrow batch may hold on its way to a Python worker: texts are long, so fewer rows than Spark's default.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 256, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; from here on the session's Arrow batches are of a size for texts."""
    for key, most in BATCH.items():
        spark.conf.set(key, str(most))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; if unset, a shared warehouse or a local folder of tests, and on other clusters an error."""
    return scratch.root(spark)


def shared_path(spark: SparkSession, label: str) -> str:
    """A path that no other call gets, in the folder that driver and executors share."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends here, and work above is done once."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def remove(df: DataFrame) -> None:
    """Deletes the table of a `cut` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_small(left: DataFrame, right: DataFrame, on, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins right, which must be cheap to count, by broadcast while it has at most `limit` rows, else by shuffle."""
    few = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if few else right, on, how)


def digest(col: Column) -> Column:
    """The 16 bytes of the MD5 of a text."""
    return F.unhex(F.md5(col.cast("binary")))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; null if the id is null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n).cast("long"))
