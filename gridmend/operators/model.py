"""A model's second opinion as a stage: bounded calls inside tasks, a cache by prompt, and an audit of what was taken and what wasn't.

The model is a function (system, user) -> text that tasks call, a few at a time each. Equal prompts are asked once, and replies are kept in
a table by the hash of their prompts, so a run that is repeated, or a task that is, asks little again. A reply changes nothing unless
`verify` finds that every claim in it holds; a failed call is a row with its error, never the run's failure. Without a model all stays as it is.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmend.operators import mapping, review, verify
from gridmend.operators.frame import keys
from gridmend.scratch import written

Model = Callable[[str, str], str]
#: calls at once in a task, tries of each, seconds before the second try, recommendations of a file that are reasoned over, values that a prompt shows
AT_ONCE, TRIES, PAUSE, REASONED, SHOWN = 8, 3, 0.2, 6, 12
_REPLIES = "prompt_key string, reply string, error string, tries int"
CHOOSE = "Name the one candidate that the column is, as a JSON object with named_column, target, phrase, shape, sample and reason; quote only what you are shown."
EXPLAIN = "Say in plain prose what the finding is, as a JSON object with named_rec, proposed_op, cited_row, cited_before, cited_after, prose and doubt; use only numbers that you are shown."
_CHOICE = "named_column string, target string, phrase string, shape string, sample string, reason string"
_PROSE = "named_rec string, proposed_op string, cited_row long, cited_before string, cited_after string, prose string, doubt string"


def _caller(model: Model, system: str, at_once: int, tries: int):
    def once(prompt: str) -> tuple[str | None, str | None, int]:
        error = None
        for k in range(tries):
            try:
                return model(system, prompt), None, k + 1
            except Exception as e:  # the audit has it
                error = f"{type(e).__name__}: {e}"
                if k + 1 < tries:
                    time.sleep(PAUSE * 2**k)
        return None, error, tries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                found = list(pool.map(once, batch.column("prompt").to_pylist()))
                replies, errors, n = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("prompt_key"), pa.array(replies, pa.string()), pa.array(errors, pa.string()), pa.array(n, pa.int32())], names=["prompt_key", "reply", "error", "tries"])

    return run


def ask_all(asked: DataFrame, model: Model, system: str, cache: str | None = None, at_once: int = AT_ONCE, tries: int = TRIES) -> DataFrame:
    """asked, which has a column prompt, with reply, error and tries; a reply from the cache has none of its own tries."""
    spark = asked.sparkSession
    own = asked.withColumn("prompt_key", F.sha2(F.concat_ws("\x1f", F.lit(system), "prompt"), 256))
    todo, known = own.select("prompt_key", "prompt").dropDuplicates(["prompt_key"]), None
    if cache:
        path = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = written(spark.read.schema(_REPLIES).parquet(cache).groupBy("prompt_key").agg(F.max("reply").alias("reply")).select("*", F.lit(None).cast("string").alias("error"), F.lit(0).alias("tries")), "cached")
            todo = todo.join(known.select("prompt_key"), "prompt_key", "left_anti")
    new = written(todo.repartition("prompt_key").mapInArrow(_caller(model, system, at_once, tries), _REPLIES), "replies")
    if cache:
        new.filter("reply is not null").write.mode("append").parquet(cache)
    return own.join(new if known is None else new.unionByName(known), "prompt_key", "left").drop("prompt_key")


def eligible(recs: DataFrame, limit: int = REASONED) -> DataFrame:
    """The first `limit` recommendations of each file's queue that are unsure enough to need words."""
    place = Window.partitionBy(*keys(recs)).orderBy("position")
    unsure = recs.filter(F.col("confidence") < verify.DOUBT_BELOW)
    return unsure.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= limit).drop("_place")


def _audit(df: DataFrame, stage: str, by: list[str]) -> DataFrame:
    """(…, stage, accepted, failures, error, reply) of every call."""
    return df.select(*by, F.lit(stage).alias("stage"), (F.col("reply").isNotNull() & (F.size("failures") == 0)).alias("accepted"), "failures", "error", "reply")


def _judged(df: DataFrame) -> DataFrame:
    """failures of replies that are no JSON object: just that."""
    return df.withColumn("failures", F.when(F.col("reply").isNull(), F.array(F.lit("no reply"))).when(F.col("_said").isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.col("failures"))).drop("_said")


def adjudicate(mappings: DataFrame, cells: DataFrame, profiled: DataFrame, phrases: DataFrame, model: Model | None, **how) -> tuple[DataFrame, DataFrame | None]:
    """(mappings, audit): columns whose runner-up is close, as a verified reply would have them.

    cells: (sheet, column_idx, value); profiled: a profile of columns named like `column_key`. A target that another column holds is never taken from it.
    """
    if model is None:
        return mappings, None
    key = column_key()
    low = mapping.low_margin(mappings).withColumns({"column": key, "candidates": F.array_compact(F.array("target", "runner_up"))})
    held = cells.withColumn("column", key)
    # the same few values in every run: the ones with the least hashes
    rank = Window.partitionBy("column").orderBy(F.xxhash64("value"), "value")
    shown = held.filter("value is not null").select("column", "value").distinct().withColumn("_k", F.row_number().over(rank)).filter(F.col("_k") <= SHOWN)
    told = low.join(shown.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("_shown")), "column", "left")
    asked = told.select("sheet", "column_idx", "column", "header", "candidates", F.to_json(F.struct("header", "candidates", F.col("_shown").alias("values"))).alias("prompt"))
    replies = ask_all(asked, model, CHOOSE, **how).withColumn("_said", verify.parse_reply(F.col("reply"), _CHOICE))
    replies = written(replies.select("*", "_said.*"), "choices")
    judged = written(_judged(verify.verify_choices(replies, held, profiled, phrases)), "judged")
    taken = verify.overrides(judged, mappings).select("sheet", "column_idx", F.col("target").alias("_new"))
    out = mappings.join(taken, ["sheet", "column_idx"], "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("target"))
    return out.withColumn("method", F.when(changed, "adjudicated").otherwise(F.col("method"))).withColumn("target", F.coalesce("_new", "target")).drop("_new"), _audit(judged, "adjudication", ["sheet", "column_idx"])


def column_key():
    """A column's name in profiles, from sheet and column_idx."""
    return F.to_json(F.struct("sheet", "column_idx"))


def reason(recs: DataFrame, findings: DataFrame, model: Model | None, limit: int = REASONED, **how) -> tuple[DataFrame, DataFrame | None]:
    """(recommendations with prose and doubt, audit): those `eligible` for it, in the words of a verified reply; the others have none."""
    if model is None:
        return recs, None
    by = keys(recs)
    ours = [*by, *review.KEY]
    some = eligible(recs, limit)
    # up to SHOWN rows of a group, so no group is gathered whole
    place = Window.partitionBy(*ours).orderBy("sheet_row", "before")
    named = [F.col(k).alias(f"_{k}") for k in ours]
    few = findings.withColumn("_k", F.row_number().over(place)).filter(F.col("_k") <= SHOWN).groupBy(*named).agg(F.sort_array(F.collect_list(F.struct("sheet_row", "before", "after"))).alias("shown"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ours]
    told = some.join(few, same, "left")
    part = lambda name: F.transform("shown", lambda x: x[name])
    told = told.select(*by, "rec_id", "rule", "field", "op", "confidence", "n_rows", part("sheet_row").alias("rows"), F.array_compact(part("before")).alias("befores"), F.array_compact(part("after")).alias("afters"))
    texts = F.concat_ws(" ", F.array_join(F.transform("rows", lambda x: x.cast("string")), " "), F.array_join("befores", " "), F.array_join("afters", " "), F.col("n_rows").cast("string"), "rec_id", "rule")
    told = told.withColumn("evidence", verify.numbers_in(texts))
    prompt = F.to_json(F.struct("rec_id", "rule", "field", "op", "confidence", "n_rows", "rows", "befores", "afters"))
    replies = ask_all(told.withColumn("prompt", prompt), model, EXPLAIN, **how).withColumn("_said", verify.parse_reply(F.col("reply"), _PROSE))
    judged = written(_judged(verify.verify_prose(replies.select("*", "_said.*"))), "reasoned")
    fine = judged.filter(F.size("failures") == 0).select(*by, "rec_id", "prose", "doubt")
    return recs.join(fine, [*by, "rec_id"], "left"), _audit(judged, "reasoning", [*by, "rec_id"])
