"""The quality rules. Rules on one row are one projection, exploded. What DQ-12, DQ-15, DQ-16 and DQ-17 need from other rows
is a row of statistics a file, gathered in one pass and broadcast, so they sit in the same projection. Only DQ-13 groups and joins back.

A finding has run columns (rule, sheet_row, field, severity, before, after, op); op and after are null where a human must decide.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend import schema as S
from gridmend.functions import clean as C
from gridmend.operators.frame import keys, mapped, only_owned, status, with_clean
from gridmend.scratch import written

FINDING_COLUMNS = ["rule", "sheet_row", "field", "severity", "before", "after", "op"]


def severity(rule: str, field: str | None) -> str:
    return "High" if rule == "DQ-01" and field in S.ELEVATED else S.RULES[rule][0]


def finding(rule: str, field: str | None, before: Column, after: Column | None = None, op: Column | str | None = None) -> Column:
    """A finding without its row; explode_findings adds that and renders `before`, once for all rules."""
    none = F.expr("cast(null as string)")
    fixed = F.expr(f"named_struct('rule', {C.quoted(rule)}, 'field', {C.quoted(field) if field else 'cast(null as string)'}, 'severity', {C.quoted(severity(rule, field))})")
    return F.struct(fixed.alias("fixed"), before.alias("before"), (none if after is None else after).alias("after"), (F.lit(op) if isinstance(op, str) else none if op is None else op).alias("op"))


@dataclass(frozen=True)
class Found:
    """A rule's finding on one field of a row, and where there is one."""

    rule: str
    field: str | None
    where: Column
    column: Column


def found(rule: str, field: str | None, where: Column, before: Column, after: Column | None = None, op: Column | str | None = None) -> Found:
    return Found(rule, field, where, finding(rule, field, before, after, op))


def with_readings(df: DataFrame) -> DataFrame:
    """df with values and statuses as plain columns."""
    df = df if any(c.startswith("c_") for c in df.columns) else with_clean(df)
    return df.withColumns({f"_status_{c}": status(df, c) for c in mapped(df) if f"_status_{c}" not in df.columns})


def _value(c: str) -> Column:
    return F.col(f"_value_{c}")


def _status(c: str) -> Column:
    return F.col(f"_status_{c}")


def _usable(c: str) -> Column:
    return F.when((_status(c) == "ok") | (_status(c) == "reformatted"), _value(c))


def dq01(df: DataFrame, year: int) -> list[Found]:
    return [found("DQ-01", S.FIELD_OF[c], _status(c) == "empty", F.col(c)) for c in mapped(df)]


def dq02(df: DataFrame, year: int) -> list[Found]:
    return [found("DQ-02", S.FIELD_OF[c], _status(c) == "unparseable", F.col(c)) for c in S.VALUE_COLUMNS if c in df.columns]


def dq03(df: DataFrame, year: int) -> list[Found]:
    return [found("DQ-03", S.FIELD_OF[c], _status(c).isin("unparseable", "fractional"), F.col(c)) for c in S.INTEGER_COLUMNS if c in df.columns]


def dq04(df: DataFrame, year: int) -> list[Found]:
    return [found("DQ-04", S.FIELD_OF[c], _usable(c) < 0, F.col(c)) for c in S.VALUE_COLUMNS if c in df.columns]


def dq05(df: DataFrame, year: int) -> list[Found]:
    return [found("DQ-05", "Year Built", ~_usable("year_built").between(S.EARLIEST_YEAR, year), F.col("year_built"))]


def dq06(df: DataFrame, year: int) -> list[Found]:
    return [found("DQ-06", S.FIELD_OF[c], _usable(c) < 1, F.col(c)) for c in ("storeys", "number_of_buildings") if c in df.columns]


def _zip_parts() -> tuple[Column, Column, Column]:
    text = C.zip_compact(F.col("zip"))
    return F.when(~C.is_null("zip"), text), text.rlike("^[0-9]+$"), C.state_code(F.col("state"))


def dq07(df: DataFrame, year: int) -> list[Found]:
    text, digits, state = _zip_parts()
    short = digits & (F.length(text) == 4) & ~state.isin(S.LEADING_ZERO_STATES)
    outside = digits & (F.length(text) == 5) & ~C.prefix_in_state(F.when(digits, F.substring(text, 1, 3)).try_cast("int"), state)
    return [found("DQ-07", "Zip", text.isNotNull() & (short | outside), C.strip(F.col("zip")))]


def dq08(df: DataFrame, year: int) -> list[Found]:
    text, digits, state = _zip_parts()
    if "state" not in df.columns:
        state = F.lit(None).cast("string")
    inside = F.regexp_replace(text, "[^0-9]", "")
    plus_four = text.rlike(r"^[0-9]{5}[-\s]?[0-9]{4}$")
    after = F.when(plus_four, F.substring(text, 1, 5)).when(digits & (F.length(text) == 4), F.concat(F.lit("0"), text)).when(F.length(inside) == 5, inside)
    fine = ~plus_four & digits & ((F.length(text) == 5) | ((F.length(text) == 4) & F.coalesce(~state.isin(S.LEADING_ZERO_STATES), F.lit(False))))
    return [found("DQ-08", "Zip", text.isNotNull() & ~fine, C.strip(F.col("zip")), after, F.when(after.isNotNull(), "zip5"))]


def dq09(df: DataFrame, year: int) -> list[Found]:
    text = C.strip(F.col("state"))
    exact = F.upper(text).isin(S.STATE_CODES) & (text == F.upper(text)) & (F.length(text) == 2)
    code = F.coalesce(C.lookup(F.lower(text), S.STATE_NAMES), F.when(F.upper(text).isin(S.STATE_CODES), F.upper(text)))
    return [found("DQ-09", "State", ~C.is_null("state") & ~exact, text, code, F.when(code.isNotNull(), "state_to_abbrev"))]


def dq10(df: DataFrame, year: int) -> list[Found]:
    return [found("DQ-10", S.FIELD_OF[c], _status(c) == "reformatted", F.col(c), C.number_text(_value(c)), "strip_currency_to_float") for c in S.VALUE_COLUMNS if c in df.columns]


def dq11(df: DataFrame, year: int) -> list[Found]:
    cell = F.col("sprinklers")
    fix = C.sprinkler_fix(cell)
    return [found("DQ-11", "Fire Sprinklers (Y/N)", ~C.is_null("sprinklers") & ~C.strip(cell).isin(S.SPRINKLER_CODES), cell, fix["after"], fix["op"])]


def dq14(df: DataFrame, year: int) -> list[Found]:
    text = C.strip(F.col("construction"))
    return [found("DQ-14", "Construction", ~C.is_null("construction") & C.is_frame(text) & (_value("storeys") > S.MAX_FRAME_STOREYS), text)]


def dq18(df: DataFrame, year: int) -> list[Found]:
    building = _value("building_value")
    return [found("DQ-18", S.FIELD_OF[c], (building > 0) & (_value(c) > building * S.COMPONENT_LIMIT), F.col(c)) for c in ("contents", "bi") if c in df.columns]


def _year_count(year: int) -> str:
    return f"_rows_of_{year}"


def dq12(df: DataFrame, year: int) -> list[Found]:
    """Placeholders; a suspicious year counts once it is repeated."""
    own = []
    if "year_built" in df.columns:
        built = _value("year_built")
        repeated = [(built == y) & (F.col(_year_count(y)) >= S.PLACEHOLDER_REPEATS) for y in S.PLACEHOLDER_YEARS]
        own.append(found("DQ-12", "Year Built", reduce(lambda a, b: a | b, repeated, built == 0), F.col("year_built"), None, "set_null"))
    if "storeys" in df.columns:
        own.append(found("DQ-12", "Storeys", _value("storeys") == 0, F.col("storeys"), None, "set_null"))
    return own + [found("DQ-12", S.FIELD_OF[c], _value(c) == 1, F.col(c), None, "set_null") for c in S.VALUE_COLUMNS if c in df.columns]


def _year_counts(df: DataFrame) -> dict[str, Column]:
    return {_year_count(y): F.count_if(_value("year_built") == y) for y in S.PLACEHOLDER_YEARS} if "year_built" in df.columns else {}


def duplicate_groups(df: DataFrame) -> DataFrame:
    """(address_key, zip_key, members, distinct_references) of locations that two rows or more share.

    Counts only, with partial sums; `dq13` writes them before rows are joined with them, so adaptive execution may split a
    location that a third of all rows share.
    """
    named = F.when(~C.is_null("reference"), C.strip(F.col("reference"))) if "reference" in df.columns else F.lit(None).cast("string")
    keyed = with_location_key(df).filter(F.col("address_key") != "")
    by_reference = keyed.groupBy(*keys(df), "address_key", "zip_key", named.alias("_ref")).agg(F.count("*").alias("_n"))
    found = by_reference.groupBy(*keys(df), "address_key", "zip_key").agg(F.sum("_n").alias("members"), F.bool_and(F.col("_ref").isNotNull() & (F.col("_n") == 1)).alias("distinct_references"))
    return found.filter("members > 1")


def with_location_key(df: DataFrame) -> DataFrame:
    address = F.when(~C.is_null("address"), C.normalise_address(F.col("address"))).otherwise("")
    zip_key = F.when(~C.is_null("zip"), F.substring(F.regexp_replace("zip", "[^0-9]", ""), 1, 5)).otherwise("") if "zip" in df.columns else F.lit("")
    return df.withColumn("address_key", address).withColumn("zip_key", zip_key)


def dq13(df: DataFrame, year: int) -> DataFrame:
    joined = with_location_key(df).join(written(duplicate_groups(df), "duplicate-groups"), [*keys(df), "address_key", "zip_key"])
    return explode_findings(joined, [found("DQ-13", "Address", F.lit(True), F.col("address"))])


def campus_rows(df: DataFrame) -> DataFrame:
    """(sheet_row) of locations that rows share which all have a reference of their own: more likely a campus than double entries."""
    df = only_owned(df)
    groups = written(duplicate_groups(df).filter("distinct_references"), "campus")
    return with_location_key(df).join(groups, [*keys(df), "address_key", "zip_key"]).select(*keys(df), "sheet_row")


def _sums(df: DataFrame) -> dict[str, Column]:
    """The number of rows and the sum of each value column."""
    return {"_rows": F.count("*")} | {f"_sum_{c}": F.coalesce(F.sum(_value(c)), F.lit(0.0)) for c in S.VALUE_COLUMNS if c in df.columns}


def _label(df: DataFrame) -> Column:
    """The first short text cell that has a totalling word."""
    has = lambda x: (F.length(C.strip(x)) <= S.TOTAL_LABEL_LENGTH) & reduce(lambda a, b: a | b, [F.lower(x).contains(w) for w in S.TOTAL_WORDS])
    return F.coalesce(*[F.when(has(F.col(c)), F.col(c)) for c in mapped(df)], F.lit(None).cast("string"))


def _is_total(df: DataFrame, labelled: Column) -> Column:
    """Whether a row equals the sum of all others; one value column is enough for a row with a label."""
    checked, agree = [], []
    for c in [c for c in S.VALUE_COLUMNS if c in df.columns]:
        here = _value(c)
        others = F.col(f"_sum_{c}") - here
        check = F.coalesce((here != 0) & (others > 0), F.lit(False))
        checked.append(check.cast("int"))
        agree.append((check & (F.abs(here - others) <= F.greatest(F.lit(1.0), F.abs(others) * S.TOLERANCE))).cast("int"))
    n_checked, n_agree = reduce(lambda a, b: a + b, checked), reduce(lambda a, b: a + b, agree)
    return (F.col("_rows") >= S.MIN_TOTAL_ROWS) & (n_checked > 0) & (n_agree >= F.when(labelled, 1).otherwise(2)) & (n_agree >= n_checked)


def dq15(df: DataFrame, year: int) -> list[Found]:
    label = C.strip(_label(df))
    before = F.coalesce(label, F.concat(F.lit("row "), F.col("sheet_row").cast("string")))
    return [found("DQ-15", None, _is_total(df, label.isNotNull()), before, None, "exclude_row")]


def dq16(df: DataFrame, year: int, tiv: str = "tiv") -> list[Found]:
    """Components against a stated total; totals rows don't count."""
    stated = C.clean_amount(F.col(tiv))["value"]
    parts = reduce(lambda a, b: a + b, [F.coalesce(_value(c), F.lit(0.0)) for c in S.VALUE_COLUMNS if c in df.columns])
    off = (stated != 0) & (parts != 0) & (F.abs(parts - stated) > F.abs(stated) * S.TOLERANCE)
    return [found("DQ-16", None, off & ~_is_total(df, _label(df).isNotNull()), F.col(tiv))]


def total_columns(df: DataFrame) -> DataFrame:
    """(header) in df's map column `unmapped` that reads most like a total insured value and has a number in it; one a file at most."""
    hint = reduce(lambda w, kv: w.when(F.lower(C.strip(F.col("header"))).contains(kv[1]), kv[0]), list(enumerate(S.TIV_HINTS))[1:], F.when(F.lower(C.strip(F.col("header"))).contains(S.TIV_HINTS[0]), 0))
    cells = df.select(*keys(df), F.explode("unmapped").alias("header", "value")).withColumn("rank", hint).filter("rank is not null")
    usable = cells.filter(C.clean_amount(F.col("value"))["value"].isNotNull())
    return usable.groupBy(*keys(df)).agg(F.min_by("header", F.struct("rank", "header")).alias("header")).filter("header is not null")


def total_column(df: DataFrame) -> str | None:
    """The header of a single file's stated total."""
    best = total_columns(df).first()
    return best["header"] if best else None


def with_total(df: DataFrame) -> DataFrame:
    """df with the stated total as column tiv, if one of its unmapped columns is that; DQ-16 reads it."""
    if keys(df) and "unmapped" in df.columns and "tiv" not in df.columns:
        found = written(total_columns(df).withColumnRenamed("header", "_total"), "total-columns")
        return df.join(found, keys(df), "left").withColumn("tiv", F.col("unmapped")[F.col("_total")]).drop("_total")
    header = total_column(df) if "unmapped" in df.columns and "tiv" not in df.columns else None
    return df.withColumn("tiv", F.col("unmapped")[header]) if header else df


def _shape() -> Column:
    return F.when(~C.is_null("year_built"), C.date_shape(C.strip(F.col("year_built"))))


def _main_shape(df: DataFrame) -> dict[str, Column]:
    """The commonest notation in Year Built, of equal ones the first to occur, and how many there are."""
    shape = _shape()
    seen = [F.struct(F.count_if(shape == name).alias("n"), (-F.min(F.when(shape == name, F.col("sheet_row")))).alias("early"), F.lit(name).alias("shape")) for name, _ in S.DATE_SHAPES]
    return {"_main": F.array_max(F.array(*seen))["shape"], "_shapes": F.size(F.filter(F.array(*seen), lambda s: s["n"] > 0))}


def dq17(df: DataFrame, year: int) -> list[Found]:
    value = _value("year_built")
    after = F.when(value == F.floor(value), C.number_text(value))
    return [found("DQ-17", "Year Built", (F.col("_shapes") > 1) & (_shape() != F.col("_main")), F.col("year_built"), after, F.when(after.isNotNull(), "to_int"))]


def _reconciled(columns: list[Found]) -> list[Found]:
    """Without findings on cells that a placeholder finding explains; that one lists them in also_flagged."""
    made = []
    for f in columns:
        beaten = [x for x in columns if x.field == f.field and x.rule in S.SUPERSEDES.get(f.rule, [])]
        winners = [x for x in columns if x.field == f.field and f.rule in S.SUPERSEDES.get(x.rule, [])]
        where = reduce(lambda a, w: a & ~F.coalesce(w.where, F.lit(False)), winners, f.where)
        also = F.array_compact(F.array(*[F.when(x.where, x.rule) for x in beaten])) if beaten else F.array().cast("array<string>")
        made.append(Found(f.rule, f.field, where, F.struct(*[f.column[x].alias(x) for x in ("fixed", "before", "after", "op")], also.alias("also"))))
    return made


def explode_findings(df: DataFrame, columns: list[Found], reconciled: bool = False) -> DataFrame:
    """A row for each finding in the columns whose condition holds.

    Conditions are plain columns, worked out once a row; the array of findings is one, too, as array_compact would work out what it is given
    without compiled code.
    """
    df = df.withColumns({f"_found_{k}": f.where for k, f in enumerate(columns)})
    columns = [Found(f.rule, f.field, F.col(f"_found_{k}"), f.column) for k, f in enumerate(columns)]
    columns = _reconciled(columns) if reconciled else columns
    made = df.select(*keys(df), "sheet_row", F.array(*[F.when(f.where, f.column) for f in columns]).alias("_findings"))
    rows = made.select(*keys(df), "sheet_row", F.explode(F.array_compact("_findings")).alias("f"))
    more = ["f.also"] if reconciled else []
    out = rows.select(*keys(df), "f.fixed.rule", "sheet_row", "f.fixed.field", "f.fixed.severity", C.render(F.col("f.before")).alias("before"), "f.after", "f.op", *more)
    return out.withColumnRenamed("also", "also_flagged")


@dataclass(frozen=True)
class Rule:
    """Either columns over one row or a DataFrame over all.

    needs: the fields without which it can't run. statistics: aggregates over all rows that its columns read, by name.
    """

    name: str
    needs: tuple[str, ...]
    apply: Callable
    across_rows: bool = False
    statistics: Callable[[DataFrame], dict[str, Column]] | None = None


REGISTRY: list[Rule] = [
    Rule("DQ-01", (), dq01),
    Rule("DQ-02", (), dq02),
    Rule("DQ-03", (), dq03),
    Rule("DQ-04", (), dq04),
    Rule("DQ-05", ("year_built",), dq05),
    Rule("DQ-06", (), dq06),
    Rule("DQ-07", ("zip", "state"), dq07),
    Rule("DQ-08", ("zip",), dq08),
    Rule("DQ-09", ("state",), dq09),
    Rule("DQ-10", (), dq10),
    Rule("DQ-11", ("sprinklers",), dq11),
    Rule("DQ-12", (), dq12, True, _year_counts),
    Rule("DQ-13", ("address",), dq13, True),
    Rule("DQ-14", ("construction", "storeys"), dq14),
    Rule("DQ-15", (), dq15, True, _sums),
    Rule("DQ-16", ("tiv",), dq16, True, _sums),
    Rule("DQ-17", ("year_built",), dq17, True, _main_shape),
    Rule("DQ-18", ("building_value",), dq18),
]


#: Rules that need any one of these columns.
SOME_OF = {"DQ-12": ["year_built", "storeys", *S.VALUE_COLUMNS], "DQ-15": S.VALUE_COLUMNS, "DQ-16": S.VALUE_COLUMNS}


def can_run(rule: Rule, df: DataFrame) -> bool:
    has = lambda columns: any(c in df.columns for c in columns)
    some = SOME_OF.get(rule.name)
    return all(n in df.columns for n in rule.needs) and (some is None or has(some))


def with_statistics(df: DataFrame, used: list[Rule]) -> DataFrame:
    """df with the statistics of the rules on each row: one pass over df, and a row a file to join."""
    wanted = {name: c for r in used if r.statistics for name, c in r.statistics(df).items()}
    if not wanted:
        return df
    if keys(df):
        by_file = written(df.groupBy(*keys(df)).agg(*[c.alias(name) for name, c in wanted.items()]), "statistics")
        return df.join(by_file, keys(df))
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(name) for name, c in wanted.items()])))


def run_rules(df: DataFrame, year: int, only: list[str] | None = None, reconciled: bool = False) -> DataFrame:
    """All findings of the rules that can run; df may be raw or with_clean.

    reconciled: findings that a placeholder explains are left out as rows are read, with no shuffle, and also_flagged says which.
    """
    df = with_readings(df)
    usable = [r for r in REGISTRY if (only is None or r.name in only) and can_run(r, df)]
    by_row = [r for r in usable if not r.across_rows or r.statistics]
    columns = [c for r in by_row for c in r.apply(df, year)]
    none = F.array().cast("array<string>")
    others = [r.apply(df, year) for r in usable if r not in by_row]
    parts = [explode_findings(with_statistics(df, by_row), columns, reconciled)] if columns else []
    return reduce(DataFrame.unionByName, parts + [x.withColumn("also_flagged", none) if reconciled else x for x in others])


def _status_by_file(df: DataFrame, findings: DataFrame) -> DataFrame:
    """As rule_status, by file: `fields` says what a file has, and a stated total counts as one of its fields."""
    files = df.groupBy(*keys(df)).agg(F.max("fields").alias("fields"), F.bool_or(F.col("tiv").isNotNull() if "tiv" in df.columns else F.lit(False)).alias("tiv"))
    have = F.when(F.col("tiv"), F.concat("fields", F.array(F.lit("tiv")))).otherwise(F.col("fields"))
    rules = df.sparkSession.createDataFrame([(r.name, list(r.needs), SOME_OF.get(r.name)) for r in REGISTRY], "rule string, needs array<string>, some array<string>")
    both = files.select(*keys(df), have.alias("have")).crossJoin(F.broadcast(rules))  # eighteen rows a file
    lacks = F.array_except("needs", "have")
    why = F.when(F.size(lacks) > 0, F.concat(F.lit("needs "), F.array_join(lacks, ", "))).when(F.col("some").isNotNull() & ~F.arrays_overlap("some", "have"), "needs a field to read")
    counted = findings.groupBy(*keys(df), "rule").agg(F.count("*").alias("n_findings"))
    out = both.select(*keys(df), "rule", why.isNull().alias("evaluated"), why.alias("reason")).join(counted, [*keys(df), "rule"], "left")
    return out.withColumn("n_findings", F.coalesce("n_findings", F.lit(0).cast("long")))


def rule_status(df: DataFrame, findings: DataFrame) -> DataFrame:
    """(rule, evaluated, reason, n_findings) of every rule; with a file key a row for each file and rule."""
    if keys(df):
        return _status_by_file(df, findings)
    names = [(r.name, can_run(r, df), None if can_run(r, df) else "needs " + (", ".join(n for n in r.needs if n not in df.columns) or "a field to read")) for r in REGISTRY]
    rules = df.sparkSession.createDataFrame(names, "rule string, evaluated boolean, reason string")
    counted = findings.groupBy("rule").agg(F.count("*").alias("n_findings"))
    return rules.join(counted, "rule", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0).cast("long")))
