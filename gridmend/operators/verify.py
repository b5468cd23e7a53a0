"""Checks on what a model says: only numbers and texts that the evidence has may stand in it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend import schema as S
from gridmend.functions.clean import normalise, strip
from gridmend.operators import mapping, profile


def numbers_in(text: Column) -> Column:
    """The different numbers of a text, without separators; percentages don't count."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?%?)"), 1), lambda x: ~x.endswith("%"))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, ",", "")))


def untraceable(text: Column, evidence: Column) -> Column:
    """Numbers of a text that the evidence, an array of texts, lacks."""
    return F.array_except(numbers_in(text), evidence)


#: Characters that an explanation has at least and at most, and the confidence below which it must state its doubt.
SHORTEST, LONGEST, DOUBT_BELOW = 40, 900, 0.70
#: How like a header a cited phrase must be, and what share of a column a cited shape must have.
LIKE_HEADER, SHARE = 0.55, 0.20


def verify_prose(replies: DataFrame) -> DataFrame:
    """replies with failures, empty if what a model wrote about a recommendation holds against its findings.

    Of the recommendation: rec_id, op, confidence, rows, befores, afters, evidence (arrays; evidence has the numbers that may be named).
    Of the reply: named_rec, proposed_op, cited_row, cited_before, cited_after, prose, doubt.
    """
    c = F.col
    absent = lambda value, among: c(value).isNotNull() & ~F.coalesce(F.array_contains(among, c(value)), F.lit(False))
    doubt = F.coalesce(F.trim("doubt"), F.lit(""))
    length = F.length(F.coalesce("prose", F.lit("")))
    checks = {
        "another recommendation": ~c("rec_id").eqNullSafe(c("named_rec")),
        "row isn't affected": absent("cited_row", "rows"),
        "value isn't there": absent("cited_before", "befores"),
        "corrected value isn't the engine's": absent("cited_after", "afters"),
        "operation differs": c("proposed_op").isNotNull() & ~c("op").eqNullSafe(c("proposed_op")),
        "a number has no evidence": F.size(untraceable(F.concat_ws(" ", "prose", "doubt"), c("evidence"))) > 0,
        "prose is too short": length < SHORTEST,
        "prose is too long": length > LONGEST,
        "doubt isn't stated": (c("confidence") < DOUBT_BELOW) & (doubt == ""),
    }
    return replies.withColumn("failures", F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()])))


def verify_choices(replies: DataFrame, cells: DataFrame, profiled: DataFrame, phrases: DataFrame) -> DataFrame:
    """replies with failures, empty if what a model said about a column's target holds against the column.

    replies: column, header, candidates, and of the reply named_column, target, phrase, shape, sample, reason. cells: (column, value).
    profiled: a profile of the columns. phrases: a glossary. Texts are looked up by joins, so columns may be of any length.
    """
    key = lambda c: F.lower(strip(c))
    values = cells.select("column", key(F.col("value")).alias("_value")).distinct()
    known = phrases.select(F.col("target").alias("_target"), key(F.col("phrase")).alias("_phrase")).distinct()
    shapes = profiled.select(F.col("column").alias("_column"), F.col("shape").alias("_shape"), "share")
    out = replies.withColumns({"_sample": key(F.col("sample")), "_cited": key(F.col("phrase")), "_named": key(F.col("shape"))})
    out = out.join(values.withColumn("_there", F.lit(True)), (values["column"] == out["column"]) & (F.col("_value") == F.col("_sample")), "left").drop(values["column"])
    out = out.join(F.broadcast(known.withColumn("_real", F.lit(True))), (F.col("_target") == F.col("target")) & (F.col("_phrase") == F.col("_cited")), "left")  # a few hundred rows
    of_shape = F.coalesce(F.sum(F.when(profile.same_shape(F.col("_named"), F.col("_shape")), F.col("share"))), F.lit(0.0))
    shares = out.select("column", "_named").distinct().join(shapes, F.col("column") == F.col("_column")).groupBy("column", "_named").agg(of_shape.alias("_share"))
    out = out.join(shares, ["column", "_named"], "left").withColumn("_like", mapping.token_set(mapping.prepare(F.col("header")), normalise(F.coalesce("phrase", F.lit("")))))
    c = F.col
    checks = {
        "another column": ~normalise(c("header")).eqNullSafe(normalise(c("named_column"))),
        "no such target": ~F.coalesce(c("target").isin(S.FIELD_NAMES), F.lit(False)),
        "not a candidate": ~F.coalesce(F.array_contains("candidates", c("target")), F.lit(False)),
        "no such phrase": c("phrase").isNotNull() & c("_real").isNull(),
        "phrase isn't like the header": c("phrase").isNotNull() & c("_real").isNotNull() & (c("_like") < LIKE_HEADER),
        "no such shape": c("shape").isNotNull() & ~c("_named").isin(profile.SHAPES),
        "column isn't of the shape": c("shape").isNotNull() & c("_named").isin(profile.SHAPES) & (F.coalesce("_share", F.lit(0.0)) < SHARE),
        "quotes a value that the column lacks": c("sample").isNotNull() & c("_there").isNull(),
        "no reason": F.coalesce(F.trim("reason"), F.lit("")) == "",
    }
    return out.withColumn("failures", F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()]))).select(*replies.columns, "failures")


def parse_reply(text: Column, schema: str) -> Column:
    """A model's JSON object, whether or not it stands in a fenced block; null if it isn't one."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z]*\s*(.*?)\s*```$", "$1")
    return F.when(F.trim(bare).startswith("{"), F.from_json(bare, schema))


def overrides(choices: DataFrame, mappings: DataFrame) -> DataFrame:
    """The choices (sheet, column_idx, target, failures) that hold and whose target no other column of the sheet has."""
    taken = mappings.filter("target is not null").select("sheet", "target", F.col("column_idx").alias("_owner"))
    fine = choices.filter(F.size("failures") == 0)
    return fine.join(taken, ["sheet", "target"], "left").filter("_owner is null or _owner = column_idx").drop("_owner")


def ask(model: Callable[[str, str], Any] | None, system: str, user: str) -> tuple[Any, str | None]:
    """(reply, error) of an optional model; without one every caller gets the same error."""
    if model is None:
        return None, "no model is set"
    try:
        return model(system, user), None
    except Exception as e:  # a model's failure is reported, never raised into the run
        return None, str(e)
