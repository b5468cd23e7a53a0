"""Column functions that read messy cells: typed values with an account of what cleaning took."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmend import schema as S

# Unicode's white space, and the marks that amounts are written with.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
MARKS = "$£€¥,"


def strip(c: Column) -> Column:
    """Without white space, of any kind, at both ends; Spark's trim takes off spaces only unless told more."""
    return F.btrim(c, F.lit(WHITE))


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def among(values: list[str]) -> str:
    """A list for SQL's IN, which is parsed at once where isin makes a column of each value."""
    return "(" + ", ".join(map(quoted, values)) + ")"


def is_null(column: str) -> Column:
    """Whether a column's cell holds nothing, or a word for nothing."""
    return F.expr(f"`{column}` is null or lower(btrim(`{column}`, {quoted(WHITE)})) in {among(S.NULL_TOKENS)}")


def lookup(key: Column, entries: dict[str, str]) -> Column:
    """The entry of a key, else null. A literal map of a fixed table, parsed at once."""
    return F.expr("map(" + ", ".join(quoted(x) for pair in entries.items() for x in pair) + ")")[key]


def amount_steps(c: Column, tag: str) -> list[dict[str, Column]]:
    """The reading of an amount in steps: columns by name, each of which reads those of the steps before it.

    The last step has value_<tag>, status_<tag> and removed_<tag>. As plain columns the steps are worked out once a row each.
    """
    at = lambda name: F.col(f"_{name}_{tag}")
    bracketed = at("text").startswith("(") & at("text").endswith(")") & (F.length(at("text")) > 1)
    return [
        {f"_text_{tag}": strip(c)},
        {f"_inner_{tag}": F.when(bracketed, F.substring(at("text"), F.lit(2), F.length(at("text")) - 2)).otherwise(at("text")), f"_empty_{tag}": at("text").isNull() | F.expr(f"lower(_text_{tag}) in {among(S.NULL_TOKENS)}")},
        {f"_bare_{tag}": F.translate(at("inner"), MARKS + WHITE, "")},
        {f"_number_{tag}": F.when(~at("empty"), F.regexp_extract(F.when(at("bare").startswith("-"), F.substring(at("bare"), 2, 1 << 30)).otherwise(at("bare")), r"^(-?[0-9]+(\.[0-9]+)?)$", 1).try_cast("double"))},
        {
            f"_value_{tag}": at("number") * F.when(bracketed | at("bare").startswith("-"), -1.0).otherwise(1.0),
            f"_status_{tag}": F.when(at("empty"), "empty").when(at("number").isNull(), "unparseable").when(bracketed | (F.length(at("bare")) < F.length(at("text"))), "reformatted").otherwise("ok"),
            f"_removed_{tag}": F.when(at("number").isNull(), "").otherwise(F.concat(F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(at("inner"), ""), lambda x: F.lit(MARKS + WHITE).contains(x) & (x != "")))), ""), F.when(bracketed, "()").otherwise(""))),
        },
    ]


def clean_amount(c: Column) -> Column:
    """struct(value, status, removed). status: empty, ok, reformatted or unparseable.

    One expression for a cell here and there; `frame.with_clean` reads whole columns by `amount_steps`, and a test holds the two together.
    """
    text = strip(c)
    empty = c.isNull() | F.lower(text).isin(S.NULL_TOKENS)
    bracketed = text.startswith("(") & text.endswith(")") & (F.length(text) > 1)
    inner = F.when(bracketed, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    bare = F.translate(inner, MARKS + WHITE, "")
    digits = F.regexp_replace(bare, "^-", "")
    number = F.regexp_extract(digits, r"^(-?[0-9]+(\.[0-9]+)?)$", 1).try_cast("double")
    value = F.when(~empty, number * F.when(bracketed | bare.startswith("-"), -1.0).otherwise(1.0))
    marks = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(inner, ""), lambda x: F.lit(MARKS + WHITE).contains(x) & (x != "")))), "")
    parsed = F.when(bracketed | (F.length(bare) < F.length(text)), "reformatted").otherwise("ok")
    status = F.when(empty, "empty").when(number.isNull(), "unparseable").otherwise(parsed)
    removed = F.when(~empty & number.isNotNull(), F.concat(marks, F.when(bracketed, "()").otherwise(""))).otherwise("")
    return F.struct(value.alias("value"), status.alias("status"), removed.alias("removed"))


def clean_integer(amount: Column) -> Column:
    """From a struct of clean_amount; status may also be fractional."""
    value = amount["value"]
    status = F.when(value != F.floor(value), "fractional").otherwise(amount["status"])
    return F.struct(value.alias("value"), status.alias("status"), amount["removed"].alias("removed"))


def clean_text(column: str) -> Column:
    return F.when(~is_null(column), strip(F.col(column)))


def number_text(v: Column) -> Column:
    """A whole number without decimals, another one as a plain decimal."""
    plain = F.regexp_replace(F.regexp_replace(v.cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(plain)


def render(c: Column) -> Column:
    return F.when(c.isNull() | (strip(c) == ""), "(empty)").otherwise(c)


def normalise(c: Column) -> Column:
    """Lower case, with runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalise(c), " "), lambda t: t != ""))


def cell_kind(c: Column, kind: Column | None = None) -> Column:
    """empty, number, date, boolean or text; kind: what the source knows of the cell."""
    text = strip(c)
    number = r"^[(\-+]?\s*[$€£¥]?\s*[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?\s*%?\s*\)?$|^[(\-+]?\s*[$€£¥]?\s*[0-9]+(?:\.[0-9]+)?\s*%?\s*\)?$"
    told = F.when(c.isNull() | (text == ""), "empty")
    told = told if kind is None else told.when(kind.isin("number", "date", "boolean"), kind)
    return told.when(text.rlike(number), "number").otherwise("text")


def normalise_address(c: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), " "), lambda w: w != "")
    folded = F.transform(words, lambda w: F.coalesce(lookup(w, S.STREET_WORDS), w))
    return F.array_join(folded, " ")


def is_frame(c: Column) -> Column:
    low = F.lower(c)
    excluded = reduce(lambda a, b: a | b, [low.contains(x) for x in S.FRAME_EXCLUSIONS])
    return ~excluded & low.rlike("\\b(" + "|".join(S.FRAME_TERMS) + ")\\b")


def date_shape(c: Column) -> Column:
    return reduce(lambda w, x: w.when(c.rlike(x[1]), x[0]), S.DATE_SHAPES[1:], F.when(c.rlike(S.DATE_SHAPES[0][1]), S.DATE_SHAPES[0][0]))


def state_code(c: Column) -> Column:
    """Words for no value are no state either."""
    text = strip(c)
    return F.when(c.isNull(), None).when(F.upper(text).isin(S.STATE_CODES), F.upper(text)).otherwise(lookup(F.lower(text), S.STATE_NAMES))


def zip_compact(c: Column) -> Column:
    return F.replace(strip(c), F.lit(" "), F.lit(""))


def prefix_in_state(prefix: Column, state: Column) -> Column:
    """Whether a three-digit prefix is one of the state's; null if the state is unknown."""
    ranges = ", ".join(f"{quoted(s)}, array(" + ", ".join(f"named_struct('lo', {lo}, 'hi', {hi})" for lo, hi in found) + ")" for s, found in S.ZIP_RANGES.items())
    return F.exists(F.expr(f"map({ranges})")[state], lambda r: prefix.between(r["lo"], r["hi"]))


def sprinkler_fix(c: Column) -> Column:
    """struct(op, after): the code that a cell stands for beyond doubt, else nulls."""
    text = strip(c)
    key = F.regexp_replace(F.lower(text), r"\.+$", "")
    figure = strip(F.replace(F.regexp_replace(text, "%+$", ""), F.lit(","), F.lit("")))
    number = F.when(figure.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), figure.try_cast("double"))
    share = number / F.when(text.endswith("%") | (number > 1), 100.0).otherwise(1.0)
    after = F.when(key.isin(S.SPRINKLER_AMBIGUOUS), None).when(share == 0, "N").when(share == 1, "Y").when(number.isNotNull(), None).otherwise(lookup(key, S.SPRINKLER_SPELLINGS))
    return F.struct(F.when(after.isNotNull(), "map_values").alias("op"), after.alias("after"))
