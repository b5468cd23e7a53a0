"""Tables that are written once in the folder that driver and executors share, where several steps read the same rows."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _local(app: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession, name: str) -> str:
    """A path that no other call gets, below `root`."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def root(spark: SparkSession) -> str:
    """The folder for tables that are written on the way; on a cluster one that driver and executors share, or an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _local(spark.sparkContext.applicationId)
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.partition(":")[0] in ("file", warehouse):
        raise RuntimeError("spark.checkpoint.dir is not set, and the warehouse is a folder of one machine: set it to a folder that driver and executors share")
    return warehouse.rstrip("/") + "/scratch"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: its work is done once, and nothing has to be released."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def join_small(left: DataFrame, right: DataFrame, on, how: str = "left", limit: int | None = None) -> DataFrame:
    """Joins right, which must be cheap to count, by broadcast while it has at most `limit` rows (BROADCAST_ROWS), else by shuffle."""
    limit = BROADCAST_ROWS if limit is None else limit
    few = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if few else right, on, how)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files are fewer than those; larger inputs stay as they are, with no shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df by the hash of `by` in a fixed number of parts, a few a core, for work whose cost isn't in its rows' bytes.

    Adaptive execution joins small partitions by their bytes, and would give few bytes with much work to one task; it leaves a number that is asked for.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)
