"""Quality rules with adaptive thresholds: quantile sketches per language and source take the place of fixed cutoffs.

Everything here is DataFrame functions; no Python runs on the executors.

1. `text_stats` counts words, symbols, repeated lines and repeated three-word windows of each whole text.
2. `thresholds` keeps a mergeable KLL sketch of each ratio per (lang, source) over rows that pass the base rules, merges
   them per lang and over all, and reads a first fence from the first level that has enough documents: the upper
   quartile plus the larger of `reach` times its distance from the median and a least spread for that ratio. That
   stays in place while less than a quarter of a group is junk; what rarer rows have below it counts as usual. The rows
   under all first fences are sketched again, and the fence is their TOP quantile plus TAIL times its distance from
   their median; only where that is less than a small floor, as in ratios that are 0 nearly everywhere, the floor takes
   its place (`at_floor` names them).
3. `apply_rules` joins each document with its group's fences: it stays if no base rule fails and no ratio is over its fence.

Defined results: a null or empty text has no words, so all counts are 0 and base_failed is true. Null lang or source is
a group of its own. Rows that repeat each get a row. A group with few documents uses its language's fences, then those
of all documents; where no document has a word there are no fences, and all rows fail the base rules anyway. Other
columns of the input pass through; those named like the counts, base_failed or kept are replaced. Without a lang or source
column, all documents share one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
MARKS = "[!-/:-@\\[-`{-~]"  # ASCII punctuation
#: How far above the upper quartile a ratio's first fence lies at least.
LEAST_SPREAD = {"symbols": 0.1, "marks": 0.2, "dup_lines": 0.5, "repeats": 0.4, "word_length": 5.0}
#: What TAIL times the distance from median to TOP quantile is at least: a guard against no spread at all.
FLOORS = {"symbols": 0.02, "marks": 0.02, "dup_lines": 0.02, "repeats": 0.02, "word_length": 0.1}
TOP, TAIL = 0.99, 2.0
MIN_GROUP = 25
REACH = 8.0
SKETCH_K = 4096
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_lines"]


def _ratios() -> dict[str, tuple[Column, float]]:
    n = F.col("n_words")
    values = {"symbols": F.col("n_symbols") / n, "marks": F.col("n_marks") / n, "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeats": F.col("n_repeat_words") / n, "word_length": F.col("word_chars") / n}
    return {name: (values[name], least) for name, least in LEAST_SPREAD.items()}


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """How many words lie in a window of three words that the array has twice or more."""
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )

    def covered(sorted_windows: Column) -> Column:
        at = F.sort_array(
            F.filter(
                F.transform(
                    sorted_windows,
                    lambda w, k: F.when((w["h"] == F.get(sorted_windows, k + 1)["h"]) | (w["h"] == F.get(sorted_windows, k - 1)["h"]), w["i"]),
                ),
                lambda i: i.isNotNull(),
            )
        )
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            at, start,
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # most texts repeat no window: that shows at less cost than where windows lie
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(placed, covered))

    return _let(hashes, counted)


def _of_words(parts: Column) -> Column:
    """Counts from a text cut at each white space."""
    words = F.array_remove(parts, "")
    counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    return F.struct(counts.alias("w"), (F.size(parts) - 1).cast("long").alias("n_spaces"))


def text_stats(docs: DataFrame) -> DataFrame:
    """docs with COUNTS of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACES.strip(" "), text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    by_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    kept = [c for c in docs.columns if c not in COUNTS]
    counts = F.struct(_let(F.split(spaced, " "), _of_words).alias("p"), by_line.alias("l"), F.length(text).cast("long").alias("n"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("symbols"), F.regexp_count(text, F.lit(MARKS)).cast("long").alias("marks"))
    own = "_counts"
    while own in kept:
        own += "_"
    c = docs.select(*[_plain(x) for x in kept], counts.alias(own))
    new = {"n_words": "p.w.n_words", "n_symbols": "symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "p.w.n_repeat_words", "n_marks": "marks", "n_lines": "l.n_lines"}
    values = {name: F.col(f"{own}.{path}") for name, path in new.items()} | {"word_chars": F.col(f"{own}.n") - F.col(f"{own}.p.n_spaces")}
    return c.select(*[_plain(x) for x in kept], *[values[name].alias(name) for name in COUNTS])


def _plain(column: str) -> Column:
    """A column of just this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _over() -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(x > F.col(f"max_{r}"), F.lit(False)) for r, (x, _) in _ratios().items()])


def _with_limits(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """stats with `max_` columns of their groups; columns of stats with these names give way."""
    names = [f"max_{r}" for r in _ratios()]
    limits = limits.select(F.col("lang").alias("_fence_lang"), F.col("source").alias("_fence_source"), *names)
    stats = stats.drop("_fence_lang", "_fence_source", *names)
    joined = join_small(stats, limits, F.col("lang").eqNullSafe(F.col("_fence_lang")) & F.col("source").eqNullSafe(F.col("_fence_source")))
    return joined.drop("_fence_lang", "_fence_source")


def _by_group(groups: DataFrame, rows: DataFrame, fence, label: str, min_group: int, k: int) -> DataFrame:
    """groups (lang, source) with fence(ratio) of each ratio's sketch of the group, its language or all rows."""
    ratios = _ratios()
    level = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(x, F.lit(k)).alias(r) for r, (x, _) in ratios.items()])
    level = cut(level, label)

    def merged(*keys: str) -> DataFrame:
        return level.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(k)).alias(r) for r in ratios])

    def fences(df: DataFrame, tag: str, *keys: str) -> DataFrame:
        return df.filter(F.col("n") >= (min_group if keys else 1)).select(*[F.col(c).alias(f"{tag}_{c}") for c in keys], *[fence(r).alias(f"{tag}_{r}") for r in ratios])

    own, lang, every = fences(level, "g", "lang", "source"), fences(merged("lang"), "l", "lang"), fences(merged(), "a")
    out = groups.join(own, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    out = out.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(every), F.lit(True), "left")
    return out.select(*groups.columns, *[F.coalesce(f"g_{r}", f"l_{r}", f"a_{r}").alias(r) for r in ratios])


def _quantile(r: str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(r), F.lit(q))


def thresholds(stats: DataFrame, min_group: int = MIN_GROUP, reach: float = REACH, k: int = SKETCH_K) -> DataFrame:
    """One row per (lang, source): a fence for each ratio, and at_floor, the ratios whose fence is set by the floor."""
    seen = stats.filter(~_failed())
    groups = stats.select("lang", "source").distinct()

    def first(r: str) -> Column:
        mid, high = _quantile(r, 0.5), _quantile(r, 0.75)
        return high + F.greatest(F.lit(reach) * (high - mid), F.lit(LEAST_SPREAD[r]))

    def second(r: str) -> Column:
        mid, top = _quantile(r, 0.5), _quantile(r, TOP)
        tail = F.lit(TAIL) * (top - mid)
        return F.struct((top + F.greatest(tail, F.lit(FLOORS[r]))).alias("max"), (tail < FLOORS[r]).alias("floor"))

    early = _by_group(groups, seen, first, "sketches", min_group, k)
    early = cut(early.select("lang", "source", *[F.col(r).alias(f"max_{r}") for r in LEAST_SPREAD]), "first-fences")
    usual = _with_limits(seen.select("lang", "source", *COUNTS), early).filter(~_over())
    late = _by_group(early, usual, second, "usual-sketches", min_group, k)
    at_floor = F.array_compact(F.array(*[F.when(F.col(r)["floor"], F.lit(r)) for r in FLOORS]))
    return late.select("lang", "source", *[F.coalesce(F.col(r)["max"], f"max_{r}").alias(f"max_{r}") for r in FLOORS], at_floor.alias("at_floor"))


def apply_rules(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """stats with base_failed and kept, each row judged by its group's fences."""
    failed = _failed()
    safe = F.when(failed, False).otherwise(~_over())  # the ratios divide by n_words, which is 50 at least there
    hidden = {c: f"_own_{c}" for c in stats.columns if c.startswith("max_")}
    judged = _with_limits(stats.withColumnsRenamed(hidden), limits).withColumn("base_failed", failed).withColumn("kept", safe)
    return judged.drop(*[f"max_{r}" for r in _ratios()]).withColumnsRenamed({b: a for a, b in hidden.items()})


def quality_rules(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs, or their columns `keep` (lang and source among them), with their counts, base_failed and kept."""
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source") if c not in docs.columns})
    stats = text_stats(docs)
    stats = cut(stats.select(*keep, *COUNTS) if keep else stats, "quality")
    return apply_rules(stats, cut(thresholds(stats), "fences"))
