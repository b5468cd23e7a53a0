"""Applies approved operations only, and says cell by cell what changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend import schema as S
from gridmend.functions import clean as C
from gridmend.operators.frame import keys, target_grid
from gridmend.scratch import join_small, written

APPROVED = ["approved", "edited"]


class NotSupported(ValueError):
    """An operation of the whitelist that has no defined meaning yet."""


def apply_decisions(recs: DataFrame, decisions: DataFrame) -> DataFrame:
    """recs with status, and the operation that a reviewer put in place of the proposed one.

    decisions: (rec_id, decision, edited_op, reviewer), decision being accept, reject, edit or escalate. Decisions on unknown recommendations
    change nothing; recommendations without a decision keep their status, at first pending.
    """
    states = {"accept": "approved", "reject": "rejected", "edit": "edited", "escalate": "escalated"}
    kept = F.col("_status") if "status" in recs.columns else F.lit("pending")
    told = F.col("_reviewer") if "reviewer" in recs.columns else F.lit(None).cast("string")
    before = F.col("_final") if "final_op" in recs.columns else F.col("op")
    recs = recs.withColumnsRenamed({"status": "_status", "reviewer": "_reviewer", "final_op": "_final"})
    out = join_small(recs, decisions, [*keys(recs), "rec_id"])
    final = F.when(F.col("decision").isNull(), before).when((F.col("status") == "edited") & F.col("edited_op").isNotNull(), F.col("edited_op")).otherwise(F.col("op"))
    out = out.withColumn("status", F.coalesce(C.lookup(F.col("decision"), states), kept)).withColumn("final_op", final).withColumn("reviewer", F.coalesce("reviewer", told))
    return out.drop("decision", "edited_op", "_status", "_reviewer", "_final")


def all_decided(recs: DataFrame) -> bool:
    """The gate before any change: nothing is pending."""
    return recs.filter("status = 'pending'").isEmpty()


def apply_op(op: Column, cell: Column, after: Column) -> Column:
    """The cell after an operation; a cell without a value has none whatever the operation. after: the finding's own proposal."""
    amount = C.clean_amount(cell)
    number = C.number_text(amount["value"])
    whole = amount["value"] == F.floor(amount["value"])
    dated = cell.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}") & after.rlike("^[0-9]+$")  # a date's year was read with the finding
    compact = C.zip_compact(cell)
    digits = F.regexp_replace(compact, "[^0-9]", "")
    zip5 = F.when(F.length(digits) == 4, F.concat(F.lit("0"), digits)).when(F.length(digits) >= 5, F.substring(digits, 1, 5)).otherwise(cell)
    mapped = F.coalesce(after, C.lookup(F.lower(C.strip(cell)), S.SPRINKLER_SPELLINGS), cell)
    state = F.coalesce(C.state_code(cell), cell)
    spaced = C.strip(F.regexp_replace(cell, r"(?U)\s+", " "))
    done = F.when(op == "set_null", None).when(op.isin("strip_currency_to_float", "to_float"), number).when(op == "to_int", F.when(whole, number).when(dated, after).otherwise(cell)).when(op == "zip5", zip5).when(op == "state_to_abbrev", state).when(op == "trim_normalise", spaced).when(op == "map_values", mapped).otherwise(cell)
    return F.when(~(cell.isNull() | F.lower(C.strip(cell)).isin(S.NULL_TOKENS)), done)


def changes(findings: DataFrame, recs: DataFrame) -> DataFrame:
    """(sheet_row, ops), by file: the operations, in order, that the approved recommendations ask for in each row.

    Operations on one cell are folded in the order of review. Each finding brings its own proposal, so a mapping is applied to every
    row and not to a few examples.
    """
    bad = recs.filter(F.col("status").isin(APPROVED) & F.col("final_op").isin(S.UNSUPPORTED_OPERATIONS)).select("final_op").first()
    if bad:
        raise NotSupported(bad["final_op"])
    by = keys(findings)
    approved = recs.filter(F.col("status").isin(APPROVED) & F.col("final_op").isNotNull()).select(*by, "rec_id", "position", "rule", "field", F.col("op").alias("_op"), "final_op", "reviewer")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    f = findings.select(*[F.col(c).alias(f"f_{c}") for c in (*by, "rule", "field", "op", "sheet_row", "after")])
    ours = reduce(lambda a, b: a & b, [same("f_rule", "rule") & same("f_field", "field") & same("f_op", "_op"), *[F.col(f"f_{k}") == F.col(k) for k in by]])
    hits = f.join(written(approved, "approved"), ours)  # a recommendation per rule, field and op of a file
    op = F.struct("position", "rec_id", "final_op", F.col("f_after").alias("after"), "reviewer", "field")
    by_row = hits.groupBy(*by, F.col("f_sheet_row").alias("sheet_row")).agg(F.sort_array(F.collect_list(op)).alias("ops"))
    return by_row  # a row has at most a few operations for each of its fields


def transform(df: DataFrame, findings: DataFrame, recs: DataFrame, sources: dict[str, str] | DataFrame | None = None, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned grid, audit): audit has a row per changed cell and per excluded row.

    Rows meet their operations in one join; all cells of a row are changed in it, and only the audit is exploded. sources: the source
    column of each field, of many files as (file_id, sources map<string,string>); at: the time of the run, for the audit.
    """
    grid, by = target_grid(df), keys(df)
    joined = grid.join(changes(findings, recs), [*by, "sheet_row"], "left")
    ops = F.coalesce("ops", F.array().cast(joined.schema["ops"].dataType))
    joined = joined.withColumn("ops", ops).withColumn("excluded", F.exists("ops", lambda o: o["final_op"] == "exclude_row"))
    step = lambda acc, o: apply_op(o["final_op"], acc, o["after"])

    def folded(cell: Column) -> Column:
        own = F.filter("ops", lambda o: o["field"].eqNullSafe(cell["field"]) & (o["final_op"] != "exclude_row"))
        return F.struct(cell["field"].alias("field"), cell["before"].alias("before"), F.aggregate(own, cell["before"], step).alias("after"), own.alias("own"))

    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(S.COLUMN_OF[f]).alias("before")) for f in S.FIELD_NAMES])
    done = written(joined.select(*by, "sheet_row", "ops", "excluded", F.transform(cells, folded).alias("cells")), "transformed")
    cleaned = done.filter("not excluded").select(*by, "sheet_row", *[F.col("cells")[k]["after"].alias(c) for k, c in enumerate(S.COLUMNS)])
    if isinstance(sources, DataFrame):
        noted, known = done.filter(F.size("ops") > 0).join(sources, by, "left"), F.col("sources")
    else:
        noted, known = done.filter(F.size("ops") > 0), F.create_map(*[F.lit(x) for f in S.FIELD_NAMES for x in (f, (sources or {}).get(f, ""))])

    def entry(cell: Column) -> Column:
        source = F.nullif(known[cell["field"]], F.lit(""))
        return F.struct(cell["field"].alias("field"), source.alias("source_column"), F.array_join(F.transform(cell["own"], lambda o: o["final_op"]), ",").alias("operation"), C.render(cell["before"]).alias("before"), C.render(cell["after"]).alias("after"), F.element_at(cell["own"], -1)["reviewer"].alias("approved_by"))

    changed = F.transform(F.filter("cells", lambda x: ~x["before"].eqNullSafe(x["after"])), entry)
    out = F.filter("ops", lambda o: o["final_op"] == "exclude_row")
    excluded = F.transform(out, lambda o: F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("source_column"), F.lit("exclude_row").alias("operation"), F.lit("row").alias("before"), F.lit("(excluded)").alias("after"), o["reviewer"].alias("approved_by")))
    entries = F.when(F.col("excluded"), excluded).otherwise(changed)
    audit = noted.select(*by, "sheet_row", F.inline(entries))
    return cleaned, audit.withColumn("changed_at", F.lit(at).cast("string"))


def self_check(cleaned: DataFrame) -> DataFrame:
    """(sheet_row, problem) of cleaned rows that break the target schema's types or ranges; columns are checked at once."""
    if [c for c in cleaned.columns if c not in ("sheet_row", *keys(cleaned))] != S.COLUMNS:
        raise ValueError("columns are not the target fields in their order")
    amounts = [F.when(C.clean_amount(F.col(c))["value"] < 0, F.lit(f"{S.FIELD_OF[c]} is negative")) for c in S.VALUE_COLUMNS]
    zips = F.when(~C.is_null("zip") & ~F.col("zip").rlike("^[0-9]{5}$"), F.lit("Zip is not five digits"))
    states = F.when(~C.is_null("state") & ~F.col("state").isin(S.STATE_CODES), F.lit("State is not a code"))
    return cleaned.select(*keys(cleaned), "sheet_row", F.explode(F.array_compact(F.array(*amounts, zips, states))).alias("problem"))


def run_metrics(grid: DataFrame, cleaned: DataFrame, audit: DataFrame) -> DataFrame:
    by = keys(grid)
    count = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    parts = count(grid, "rows_processed"), count(cleaned, "rows_output"), count(audit, "audit_entries")
    one = reduce(lambda a, b: a.join(b, by, "left") if by else a.crossJoin(b), parts).fillna(0, ["rows_output", "audit_entries"])
    return one.withColumn("rows_excluded", F.col("rows_processed") - F.col("rows_output"))
