"""The rules that read one row, over a stream of schedule rows. Rules across rows need whole files: `files` waits for those that arrive in pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gridmend.operators import rules


def local_findings(stream: DataFrame, year: int) -> DataFrame:
    """A stateless stream of findings from a stream of frames: no watermark and no state are needed."""
    df = rules.with_readings(stream)
    found = [c for r in rules.REGISTRY if not r.across_rows and all(n in df.columns for n in r.needs) for c in r.apply(df, year)]
    return rules.explode_findings(df, found)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that has arrived, as Parquet below path; the checkpoint makes each row count once."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def per_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """work on each micro-batch as a whole: the way to run rules across rows on files that arrive complete."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
