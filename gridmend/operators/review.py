"""From findings to a review queue: reconciliation, issues, counts, recommendations and their examples; of each file, if there is a file key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmend import schema as S
from gridmend.functions.clean import lookup
from gridmend.operators.frame import keys

KEY = ["rule", "field", "op"]


def reconcile(findings: DataFrame) -> DataFrame:
    """Drops range findings on cells that a placeholder finding explains; the survivor lists them in also_flagged."""
    losers = sorted({x for found in S.SUPERSEDES.values() for x in found})
    cell = Window.partitionBy(*keys(findings), "field", "sheet_row")  # a cell has a handful of findings
    seen = F.sort_array(F.collect_set(F.when(F.col("rule").isin([*S.SUPERSEDES, *losers]), F.col("rule"))).over(cell))
    rows = findings.withColumn("_seen", seen)
    for winner, beaten in S.SUPERSEDES.items():
        rows = rows.filter(~(F.col("rule").isin(beaten) & F.array_contains("_seen", winner)))
    also = F.coalesce(*[F.when(F.col("rule") == w, F.array_intersect("_seen", F.array(*map(F.lit, b)))) for w, b in S.SUPERSEDES.items()], F.array().cast("array<string>"))
    return rows.withColumn("also_flagged", also).drop("_seen")


def issues(findings: DataFrame) -> DataFrame:
    """(rule, field, severity) with how many rows and which are first and last."""
    return findings.groupBy(*keys(findings), "rule", "field", "severity").agg(F.countDistinct("sheet_row").alias("n_rows"), F.min("sheet_row").alias("first_row"), F.max("sheet_row").alias("last_row"))


def issue_rows(findings: DataFrame) -> DataFrame:
    """(rule, field, severity, sheet_row), each once: the rows of an issue stay rows, however many they are."""
    return findings.select(*keys(findings), "rule", "field", "severity", "sheet_row").distinct()


def counts(findings: DataFrame) -> DataFrame:
    """Findings by severity, by rule and by kind of action, as one aggregation over three groupings."""
    kinds = ("severity", "rule", "action_type")
    by = [F.col(k) for k in keys(findings)]
    rows = findings.select(*by, "severity", "rule", action().alias("action_type"))
    sets = rows.groupingSets([[*by, F.col(k)] for k in kinds], *by, *kinds).agg(F.count("*").alias("n"), F.grouping_id().alias("_set"))
    # the last grouped column is the lowest bit of grouping_id; a set bit means not grouped by
    kind = F.when(F.col("_set") == 3, kinds[0]).when(F.col("_set") == 5, kinds[1]).otherwise(kinds[2])
    return sets.select(*by, kind.alias("kind"), F.coalesce(*kinds).alias("name"), "n")


def action() -> Column:
    return F.coalesce(lookup(F.col("op"), {k: v for k, (_, v) in S.OPERATIONS.items()}), F.lit("flag_for_review"))


def confidence() -> Column:
    by_op = lookup(F.col("op"), {k: str(v) for k, (v, _) in S.OPERATIONS.items()}).cast("double")
    by_rule = lookup(F.col("rule"), {k: str(v) for k, (_, v) in S.RULES.items() if v}).cast("double")
    return F.coalesce(by_op, by_rule, F.lit(S.DEFAULT_FLAG_CONFIDENCE))


def severity_rank(c: Column) -> Column:
    return lookup(c, {k: str(v) for k, v in S.SEVERITY_RANK.items()}).cast("int")


def recommendations(findings: DataFrame, campus: DataFrame | None = None) -> DataFrame:
    """One row per (rule, field, op), numbered in the order of review: worst first, then rule, field and size.

    campus: (sheet_row) of duplicate locations whose rows have references of their own; a group that begins with one is less sure.
    """
    by = keys(findings)
    groups = findings.groupBy(*by, *KEY).agg(F.min("severity").alias("severity"), F.count("*").alias("n_findings"), F.countDistinct("sheet_row").alias("n_rows"), F.min("sheet_row").alias("first_row"), F.max("sheet_row").alias("last_row"))
    groups = groups.withColumn("confidence", confidence())
    if campus is not None:
        marked = campus.select(*by, F.col("sheet_row").alias("first_row"), F.lit("DQ-13").alias("rule"), F.lit(True).alias("_campus")).distinct()
        groups = groups.join(marked, [*by, "rule", "first_row"], "left")
        groups = groups.withColumn("confidence", F.when(F.col("_campus"), F.least(F.col("confidence"), F.lit(S.CAMPUS_CONFIDENCE))).otherwise(F.col("confidence"))).drop("_campus")
    # a group per rule, field and operation: at most a few dozen rows a file
    queue = Window.partitionBy(*by).orderBy(severity_rank(F.col("severity")), "rule", F.coalesce("field", F.lit("")), F.desc("n_findings"), F.coalesce("op", F.lit("")))
    return groups.withColumn("position", F.row_number().over(queue)).select(
        *by, F.concat(F.lit("R-"), F.lpad(F.col("position").cast("string"), 3, "0")).alias("rec_id"), "position", *KEY, action().alias("action_type"), "severity", "n_findings", "n_rows", "first_row", "last_row", F.round("confidence", 2).alias("confidence"),
        (F.col("confidence") < S.UNCERTAINTY_BELOW).alias("uncertain"),
    )


def examples(findings: DataFrame, limit: int = S.EXAMPLES) -> DataFrame:
    """(rule, field, op, sheet_row, before, after): up to `limit` examples a group, each different change first.

    Of each different change only the first rows are kept before groups are ranked, so no group is gathered whole.
    """
    by = keys(findings)
    same = Window.partitionBy(*by, *KEY, "before", "after").orderBy("sheet_row")
    rows = findings.filter("op is not null").withColumn("_again", F.row_number().over(same)).filter(F.col("_again") <= limit)
    order = Window.partitionBy(*by, *KEY).orderBy(F.when(F.col("_again") == 1, 0).otherwise(1), "sheet_row", "before")
    return rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= limit).select(*by, *KEY, "sheet_row", "before", "after")


def invalid(recs: DataFrame, findings: DataFrame) -> DataFrame:
    """Recommendations that break their own contract; a sound engine returns no rows."""
    bad = F.when(F.col("op").isNull() != (F.col("action_type") == "flag_for_review"), "op and action disagree").when(F.col("n_rows") < 1, "no rows").when(~F.col("confidence").between(0, 1), "confidence out of range")
    filled = findings.filter("op = 'set_null' and after is not null").select(F.lit(None).cast("string").alias("rec_id"), F.lit("set_null has a value").alias("problem"))
    return recs.select("rec_id", bad.alias("problem")).filter("problem is not null").unionByName(filled)
