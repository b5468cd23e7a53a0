"""How complete a frame is, and one figure for its quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmend import schema as S
from gridmend.functions.clean import lookup
from gridmend.operators.frame import keys, mapped, status, with_clean


def completeness(df: DataFrame) -> DataFrame:
    """A row per target field: whether it is mapped, its cells with a value, and their share. One pass, one row a file before it is turned."""
    df = df if any(c.startswith("c_") for c in df.columns) else with_clean(df)
    own = mapped(df)
    have = [F.max("fields").alias("_fields")] if "fields" in df.columns else []
    one = df.groupBy(*keys(df)).agg(F.count("*").alias("n"), *have, *[F.count_if(status(df, c) != "empty").alias(f"n_{c}") for c in own])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), (F.array_contains("_fields", S.COLUMN_OF[f]) if have else F.lit(S.COLUMN_OF[f] in own)).alias("mapped"), F.col("n").alias("n_rows"), (F.col(f"n_{S.COLUMN_OF[f]}") if S.COLUMN_OF[f] in own else F.lit(0).cast("long")).alias("non_null"), F.lit(S.WEIGHTS[f]).alias("weight")) for f in S.FIELD_NAMES])
    share = F.round(F.coalesce(F.try_divide(F.col("non_null").cast("double"), F.col("n_rows")), F.lit(0.0)), 4)
    return one.select(*keys(df), F.inline(rows)).withColumn("completeness", share)


def quality_score(complete: DataFrame, findings: DataFrame) -> DataFrame:
    """completeness, validity, coverage and score, each rounded to 4 places; of each file, if there is a file key."""
    by = keys(complete)
    terms = complete.groupBy(*by).agg(F.max("n_rows").alias("n"), F.sum("weight").alias("w"), F.round(F.sum(F.col("completeness") * F.col("weight")) / F.sum("weight"), 4).alias("completeness"), F.round(F.sum(F.when(F.col("mapped"), F.col("weight")).otherwise(0.0)) / F.sum("weight"), 4).alias("coverage"))
    cost = lookup(F.col("severity"), {k: str(v) for k, v in S.SEVERITY_COST.items()}).cast("double") * F.coalesce(lookup(F.col("field"), {k: str(v) for k, v in S.WEIGHTS.items()}).cast("double"), F.lit(1.0))
    costs = findings.filter("rule != 'DQ-01'").groupBy(*by).agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"))
    both = terms.join(costs, by, "left").fillna({"cost": 0.0}) if by else terms.crossJoin(F.broadcast(costs))  # one row each
    validity = F.when(F.col("n") > 0, F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("cost"), F.col("n") * F.col("w")))).otherwise(1.0)
    out = both.withColumn("validity", F.round(validity, 4))
    total = sum(F.col(k) * w for k, w in S.SCORE_WEIGHTS.items())
    return out.select(*by, "completeness", "validity", "coverage", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias("score"))


def value_gaps(complete: DataFrame) -> DataFrame:
    """Value fields that are mapped but hold nothing."""
    return complete.filter(F.col("field").isin(S.VALUE_FIELDS) & F.col("mapped") & (F.col("completeness") == 0)).select(*keys(complete), "field")
