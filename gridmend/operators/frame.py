"""The mapped frame: raw cells of the target fields with their cleaned readings beside them.

A frame holds one schedule, or those of many files if it has the column FILE. Then every operator on frames, findings or recommendations works by
file: what one file holds changes nothing in another's results. `fields`, if there, is an array of the target columns that a row's file
has a column for; the others count as absent, not as empty. `kinds`, if there, maps columns to the kind of a cell that is no text: number,
date or boolean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend import schema as S
from gridmend.functions import clean as C


FILE = "file_id"


def keys(df: DataFrame) -> list[str]:
    """What tells files apart: FILE, or nothing in a table of one file."""
    return [FILE] if FILE in df.columns else []


def owned(df: DataFrame, column: str, x: Column) -> Column:
    """x, or null where a row's file has no such column."""
    return F.when(F.array_contains("fields", column), x) if "fields" in df.columns else x


def only_owned(df: DataFrame) -> DataFrame:
    """df with the target columns that a row's file lacks as null."""
    return df.withColumns({c: owned(df, c, F.col(c)) for c in mapped(df)}) if "fields" in df.columns else df


def mapped(df: DataFrame) -> list[str]:
    """The target columns that a frame has, in their order."""
    return [c for c in S.COLUMNS if c in df.columns]


def select_mapping(df: DataFrame, mapping: dict[str, str], row: str = "sheet_row") -> DataFrame:
    """Source columns as target columns; what no target took goes into a map by header, column_{i} (from 0) for a blank one."""
    headers = {c: c if c.strip() else f"column_{k}" for k, c in enumerate(x for x in df.columns if x != row)}
    rest = [c for c in df.columns if c not in mapping.values() and c != row]
    unmapped = F.create_map(*[x for c in rest for x in (F.lit(headers[c]), F.col(f"`{c}`").cast("string"))]) if rest else F.create_map().cast("map<string,string>")
    return df.select(F.col(row).cast("long").alias("sheet_row"), *[F.col(f"`{mapping[f]}`").cast("string").alias(S.COLUMN_OF[f]) for f in S.FIELD_NAMES if f in mapping], unmapped.alias("unmapped"))


def target_grid(df: DataFrame) -> DataFrame:
    """All target columns in their order, null where a frame has none."""
    df = only_owned(df)
    return df.select(*keys(df), "sheet_row", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in S.COLUMNS])


def with_clean(df: DataFrame) -> DataFrame:
    """df with `c_<column>` structs for the value and integer fields.

    They are made of `_value_`, `_status_` and `_removed_` columns, which stay beside them: the optimizer works out a plain column
    once a row, but copies what a struct is made of into every use of its parts.
    """
    columns = [c for c in S.VALUE_COLUMNS + S.INTEGER_COLUMNS if c in df.columns]
    out = only_owned(df)
    for step in zip(*(C.amount_steps(F.col(c), c) for c in columns)):
        out = out.withColumns({name: x for found in step for name, x in found.items()})
    if "kinds" in df.columns:
        date = {c: F.coalesce(F.col("kinds")[c] == "date", F.lit(False)) for c in columns if c in S.INTEGER_COLUMNS}
        read = {"value": lambda c: F.substring(c, 1, 4).try_cast("double"), "status": lambda c: F.lit("reformatted"), "removed": lambda c: F.lit("date")}
        out = out.withColumns({f"_{part}_{c}": F.when(is_date, x(c)).otherwise(F.col(f"_{part}_{c}")) for c, is_date in date.items() for part, x in read.items()})
    parts = lambda c: [F.col(f"_{part}_{c}") for part in ("value", "status", "removed")]
    whole = {f"_status_{c}": F.when(F.col(f"_value_{c}") != F.floor(F.col(f"_value_{c}")), "fractional").otherwise(F.col(f"_status_{c}")) for c in columns if c in S.INTEGER_COLUMNS}
    masked = {f"_{part}_{c}": owned(df, c, F.col(f"_{part}_{c}")) for c in columns for part in ("value", "status")} if "fields" in df.columns else {}
    out = out.withColumns(whole).withColumns(masked).drop(*[f"_{part}_{c}" for c in columns for part in ("text", "inner", "empty", "bare", "number")])
    return out.withColumns({f"c_{c}": F.struct(*[x.alias(part) for part, x in zip(("value", "status", "removed"), parts(c))]) for c in columns})


def status(df: DataFrame, column: str) -> Column:
    """A field's status; text fields are ok or empty."""
    if column in S.VALUE_COLUMNS + S.INTEGER_COLUMNS:
        return F.col(f"_status_{column}")
    return owned(df, column, F.when(C.is_null(column), "empty").otherwise("ok"))


def typed(df: DataFrame) -> DataFrame:
    """Typed values: numbers only where cleaning ended well, whole numbers as long, texts stripped."""
    out = with_clean(df)
    fine = lambda c: F.col(f"_status_{c}").isin("ok", "reformatted")
    made = []
    for c in mapped(df):
        if c in S.VALUE_COLUMNS:
            made.append(F.when(fine(c), F.col(f"_value_{c}")).alias(c))
        elif c in S.INTEGER_COLUMNS:
            made.append(F.when(fine(c), F.col(f"_value_{c}").cast("long")).alias(c))
        else:
            made.append(C.clean_text(c).alias(c))
    return out.select(*keys(df), "sheet_row", *made)
