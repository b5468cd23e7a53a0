"""What a column's values look like: the shape of each value, a profile of a column, and how it fits each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend import schema as S
from gridmend.functions.clean import strip
from gridmend.scratch import written

MIN_SAMPLE, SECOND_WEIGHT = 3, 0.6
LEAN_ROWS, LEAN_RATIO, ZIP_SPREAD = 8, 0.4, 120.0
# yes/no words, Canadian provinces beside the states, and street words.
BOOLEANS = ["y", "n", "yes", "no", "true", "false", "t", "f", "yes.", "none", "y/n", "partial", "full", "unsprinklered", "sprinklered"]
PROVINCES = ["AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT"]
STREET = "st|street|ave|avenue|rd|road|blvd|boulevard|dr|drive|ln|lane|way|ct|court|pl|place|pkwy|parkway|hwy|highway|cir|circle|ter|terrace|trl|trail|sq|square"
NUMBER = r"^[\s$£€]*\(?-?[0-9,]+(\.[0-9]+)?\)?\s*$"
# The shapes that each target accepts, best first.
TARGET_SHAPES: dict[str, list[str]] = {
    "Reference": ["identifier", "small_int", "zip"], "Address": ["street_address", "place_name"], "City": ["place_name", "category"],
    "State": ["us_state", "place_name"], "Zip": ["zip", "identifier"], "County": ["place_name", "category"],
    "Country": ["place_name", "identifier", "category"], "Building Value": ["currency"], "Contents": ["currency"], "BI": ["currency"],
    "Occupancy": ["category", "place_name"], "Construction": ["category", "place_name"], "Storeys": ["small_int"],
    "Number of Buildings": ["small_int"], "Year Built": ["year"], "Fire Sprinklers (Y/N)": ["boolean", "category"], "Other": ["currency"],
}


def as_number(text: Column) -> Column:
    """A stripped text as a number, if it is written as one."""
    digits = F.regexp_replace(text, "[^0-9.]", "")
    value = F.when(text.rlike(NUMBER) & digits.rlike("[0-9]"), digits.try_cast("double"))
    return F.when(text.rlike(r"^\(|\)$|^-"), -value).otherwise(value)


def has_value(c: Column, kind: Column | None = None) -> Column:
    """Whether a cell has a shape: it holds something, and no word for nothing unless the source knows better."""
    text = strip(c)
    named = ~F.lower(text).isin(S.PROFILE_NULL_TOKENS)
    told = named if kind is None else named | F.coalesce(kind.isin("date", "boolean"), F.lit(False))
    return c.isNotNull() & (text != "") & told


def _marked(text: Column) -> Column:
    return text.rlike(r"[$£€,]|\.[0-9]")


def classify_value(c: Column, year: int, kind: Column | None = None) -> Column:
    """The most telling shape of a cell; `digits` where only the column can tell a zip from an amount; null for no value.

    kind: what the source knows of the cell; a date reads as a year, a boolean as such. One expression for a cell here and there, which
    reads the text again at each mention; `classified` reads whole columns.
    """
    text = strip(c)
    return _shape(c, text, as_number(text), _marked(text), year, kind)


def classified(df: DataFrame, year: int) -> DataFrame:
    """df with the `shape` of its value (and type). The readings of a text are plain columns, so that each is worked out once a row."""
    read = df.withColumn("_text", strip(F.col("value"))).withColumns({"_n": as_number(F.col("_text")), "_marked": _marked(F.col("_text"))})
    shape = _shape(F.col("value"), F.col("_text"), F.col("_n"), F.col("_marked"), year, F.col("type") if "type" in df.columns else None)
    return read.withColumn("shape", shape).drop("_text", "_n", "_marked")


def _shape(c: Column, text: Column, n: Column, marked: Column, year: int, kind: Column | None) -> Column:
    told = F.when(c.isNull() | (text == ""), None)
    told = told if kind is None else told.when(kind == "date", "year").when(kind == "boolean", "boolean")
    whole = n == F.floor(n)
    numeric = (
        F.when(whole & ~marked & n.between(1700, year + 2) & (F.length(text) == 4), "year")
        .when(marked | ~whole | (n < 0) | (n >= 100_000), "currency")
        .when(n >= 100, "digits")
        .otherwise("small_int")
    )
    return (
        told.when(F.lower(text).isin(S.PROFILE_NULL_TOKENS), None)
        .when(F.lower(text).isin(BOOLEANS), "boolean")
        .when(F.upper(text).isin(S.STATE_CODES + PROVINCES), "us_state")
        .when(text.rlike(r"^[A-Za-z][0-9][A-Za-z]\s?[0-9][A-Za-z][0-9]$"), "zip")
        .when(n.isNotNull(), numeric)
        .when(text.rlike(rf"(?i)^[0-9]+[\w\-]*\s+\S+.*?\b({STREET})\b") | text.rlike(r"^[0-9]+\s+[A-Za-z]"), "street_address")
        .when(text.rlike(r"^[A-Za-z][A-Za-z\s.'\-]{1,40}$"), "place_name")
        .when(text.rlike(r"^[\w\-/.]+$"), "identifier")
        .otherwise("category")
    )


def cells(df: DataFrame, columns: list[str], order: str = "sheet_row", sample: int | None = None) -> DataFrame:
    """(column, pos, value) of all rows, or of the first `sample` ones."""
    first = df.orderBy(order).limit(sample) if sample else df
    return first.select(F.col(order).alias("pos"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("x")).select("x.column", "pos", "x.value")


def _shaped(values: DataFrame, year: int) -> DataFrame:
    """(column, shape, v, n, first_pos): the different texts of each column, with how many cells have them.

    Cells are counted by their text as it stands before texts are classified, so that each different one of a column is read once.
    """
    typed = [c for c in ("type",) if c in values.columns]
    filled = values.filter(has_value(F.col("value"), F.col("type") if typed else None))
    texts = filled.groupBy("column", "value", *typed).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    rows = classified(texts, year).withColumn("v", F.lower(strip(F.col("value"))))
    return rows.groupBy("column", "shape", "v").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))


def _digits(shaped: DataFrame) -> DataFrame:
    """(column, digits_are), from the different numbers of each column."""
    d = shaped.filter("shape = 'digits'").select("column", "n", F.col("v").alias("t"), F.col("v").cast("long").alias("x"), F.length(F.regexp_replace("v", "^0+", "")).alias("w"))
    found = d.groupBy("column").agg(F.bool_or(F.length("t").isin(4, 5) & F.col("t").startswith("0")).alias("led"), F.bool_or(F.col("x") == 0).alias("zero"), F.bool_and(F.col("w").isin(4, 5)).alias("wide"), F.bool_and(F.col("x") % 100 == 0).alias("round"), F.sum("n").alias("k"), (F.max("x") / F.greatest(F.min("x"), F.lit(1))).alias("spread"))
    currency = F.col("zero") | ~F.col("wide") | ((F.col("k") >= 3) & F.col("round")) | (F.col("spread") > ZIP_SPREAD)
    return found.select("column", F.when(F.col("led"), "zip").when(currency, "currency").otherwise("zip").alias("digits_are"))


def resolve_digits(values: DataFrame, year: int) -> DataFrame:
    """(column, digits_are): zip or currency, for columns that hold bare numbers of three to five digits."""
    return _digits(_shaped(values, year))


def profile(values: DataFrame, year: int) -> DataFrame:
    """(column, shape, n, share, non_empty, distinct_ratio): the shapes of each column, after columns have settled what digits are.

    Cells are counted by column and text before anything is classified or joined; the rest works on those counts.
    """
    shaped = written(_shaped(values, year), "shapes")  # read three times
    whole = shaped.groupBy("column", "v").agg(F.sum("n").alias("n")).groupBy("column").agg(F.sum("n").alias("non_empty"), F.count("*").alias("_different"))
    whole = whole.select("column", "non_empty", F.round(F.col("_different") / F.col("non_empty"), 4).alias("distinct_ratio"))
    counted = shaped.groupBy("column", "shape").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    settled = counted.join(_digits(shaped), "column", "left").join(whole, "column")
    leans = (F.col("non_empty") >= LEAN_ROWS) & (F.col("distinct_ratio") <= LEAN_RATIO)
    shape = F.when(F.col("shape") == "digits", F.col("digits_are")).when((F.col("shape") == "place_name") & leans, "category").otherwise(F.col("shape"))
    return settled.groupBy("column", shape.alias("shape"), "non_empty", "distinct_ratio").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos")).withColumn("share", F.round(F.col("n") / F.col("non_empty"), 4))


def dominant(profiled: DataFrame) -> DataFrame:
    """(column, shape, share) of the most common shape; the one seen first wins a tie."""
    return profiled.groupBy("column").agg(F.max_by(F.struct("shape", "share"), F.struct("n", -F.col("first_pos"))).alias("x")).select("column", "x.shape", "x.share")


# The shapes that a value may have.
SHAPES = ["currency", "zip", "year", "small_int", "us_state", "boolean", "street_address", "place_name", "identifier", "category"]
#: Pairs of shapes that no value tells apart.
ALIKE = [("place_name", "category"), ("zip", "identifier")]


def same_shape(a: Column, b: Column) -> Column:
    """Whether two shapes are equal or of a pair that values don't tell apart."""
    pairs = [((a == x) & (b == y)) | ((a == y) & (b == x)) for x, y in ALIKE]
    return (a == b) | pairs[0] | pairs[1]


def fingerprint(profiled: DataFrame) -> DataFrame:
    """(column, target, fingerprint, abstained) for every target."""
    weights = profiled.sparkSession.createDataFrame([(t, s, 1.0 if k == 0 else SECOND_WEIGHT) for t, shapes in TARGET_SHAPES.items() for k, s in enumerate(shapes)], "target string, shape string, weight double")
    columns = profiled.groupBy("column").agg(F.max("non_empty").alias("non_empty"))
    pairs = columns.crossJoin(F.broadcast(weights))  # some thirty rows of fixed weights
    score = pairs.join(profiled.select("column", "shape", "n"), ["column", "shape"], "left").groupBy("column", "target", "non_empty").agg(F.sum(F.coalesce("n", F.lit(0)) * F.col("weight") / F.col("non_empty")).alias("s"))
    few = F.col("non_empty") < MIN_SAMPLE
    return score.select("column", "target", F.when(few, 0.0).otherwise(F.round(F.least(F.col("s"), F.lit(1.0)), 4)).alias("fingerprint"), few.alias("abstained"))
