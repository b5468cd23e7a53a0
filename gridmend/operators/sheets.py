"""Which sheet holds the schedule and where its header is, from cells in long form (sheet, row_idx, col_idx, value).

sheet is any key of a sheet, of one file or many. Cells may have a type (text, number, date, boolean) that the source knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmend.functions.clean import cell_kind, normalise, strip
from gridmend.scratch import written

SCAN, MIN_SCORE, MIN_UNIQUE, SPARSE = 30, 0.38, 0.25, 0.6
HEADER_WEIGHTS = {"label_density": 0.25, "fill": 0.10, "uniqueness": 0.15, "type_consistency": 0.25, "vocabulary": 0.25}
SHEET_WEIGHTS = {"header_density": 0.25, "type_consistency": 0.20, "null_ratio": 0.10, "row_continuity": 0.10, "vocabulary_overlap": 0.25, "data_scale": 0.10}
FULL_SCALE, N_TARGETS = 1000, 17
SEPARATOR = " › "


def trim_grid(cells: DataFrame) -> DataFrame:
    """Cells with a value, with n_rows and n_cols of their sheet; blank trailing rows and columns don't count."""
    filled = cells.filter(F.col("value").isNotNull() & (strip(F.col("value")) != ""))
    return filled.join(_sizes(filled), "sheet")


def _sizes(filled: DataFrame) -> DataFrame:
    """(sheet, n_rows, n_cols): a row a sheet, written, so that Spark knows its size and cells need no shuffle to meet it."""
    return written(filled.groupBy("sheet").agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols")), "sizes")


def _kind(df: DataFrame) -> Column:
    return cell_kind(F.col("value"), F.col("type") if "type" in df.columns else None)


def merge_fill(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Cells with the anchor of each merged span (sheet, r0, c0, r1, c1) copied over it; a later span wins over an earlier one.

    Spans are cut off at the last row and column that hold anything, so a span over all a sheet could have makes no more cells than the sheet's grid.
    """
    content = ["value", *(["type"] if "type" in cells.columns else [])]
    filled = cells.filter(F.col("value").isNotNull() & (strip(F.col("value")) != ""))
    inside = spans.join(_sizes(filled), "sheet").filter("r0 < n_rows and c0 < n_cols").select("sheet", "r0", "c0", F.least("r1", F.col("n_rows") - 1).alias("r1"), F.least("c1", F.col("n_cols") - 1).alias("c1"))
    anchors = filled.join(written(inside, "spans").withColumnsRenamed({"r0": "row_idx", "c0": "col_idx"}), ["sheet", "row_idx", "col_idx"])
    rows = anchors.select("sheet", F.col("row_idx").alias("r0"), F.col("col_idx").alias("c0"), F.struct(*content).alias("_anchor"), F.explode(F.sequence("row_idx", "r1")).alias("row_idx"), "c1")
    over = rows.select("sheet", "r0", "c0", "_anchor", "row_idx", F.explode(F.sequence("c0", "c1")).alias("col_idx"))
    last = written(over.groupBy("sheet", "row_idx", "col_idx").agg(F.max_by("_anchor", F.struct("r0", "c0")).alias("_anchor")), "merged")
    place = ["sheet", "row_idx", "col_idx"]
    rest = cells.join(last.select(*place), place, "left_anti").select(*place, *content)
    return rest.unionByName(last.select(*place, "_anchor.*"))


def type_consistency(grid: DataFrame, starts: DataFrame, sample: int | None = None) -> DataFrame:
    """(sheet, start, type_consistency): mean share of a column's commonest kind in the rows from start on.

    starts: (sheet, start) with at most SCAN + 1 rows a sheet. Cells are counted once, by column and kind, for each row that a start can
    be and for all rows below together, whatever the number of starts; a start adds up the counts from its row on.
    sample: read about so many rows a sheet, at a stride fixed by their number.
    """
    if sample:
        body = grid.join(starts, "sheet").filter("row_idx >= start")
        body = body.filter((F.col("row_idx") - F.col("start")) % F.ceil((F.col("n_rows") - F.col("start")) / sample) == 0)
        by_kind = body.groupBy("sheet", "start", "col_idx", _kind(grid).alias("kind")).agg(F.count("*").alias("n"))
    else:
        step = F.least(F.col("row_idx"), F.lit(SCAN)).alias("step")
        counts = grid.groupBy("sheet", "col_idx", _kind(grid).alias("kind"), step).agg(F.count("*").alias("n"))
        by_kind = counts.join(starts, "sheet").filter("step >= start").groupBy("sheet", "start", "col_idx", "kind").agg(F.sum("n").alias("n"))
    by_column = by_kind.groupBy("sheet", "start", "col_idx").agg((F.max("n") / F.sum("n")).alias("share"))
    return by_column.groupBy("sheet", "start").agg(F.avg("share").alias("type_consistency"))


def header_candidates(grid: DataFrame, matches: DataFrame) -> DataFrame:
    """The factors and score of each of a sheet's first rows as a header. matches: (value, target) of header-like texts."""
    top = grid.filter(F.col("row_idx") < SCAN)
    text = normalise(F.col("value"))
    rows = top.groupBy("sheet", "row_idx", "n_cols").agg(F.count("*").alias("filled"), F.countDistinct(text).alias("distinct"))
    rows = rows.filter((F.col("filled") >= 2) & (F.col("distinct") / F.col("filled") >= MIN_UNIQUE))
    cells = top.join(matches, "value", "left").groupBy("sheet", "row_idx", text.alias("_t")).agg(F.max_by(_kind(top), -F.col("col_idx")).alias("kind"), F.max("target").alias("target"))
    by_row = cells.groupBy("sheet", "row_idx").agg(F.avg((F.col("kind") == "text").cast("double")).alias("label_density"), F.avg(F.col("target").isNotNull().cast("double")).alias("vocabulary"))
    steady = type_consistency(grid, rows.select("sheet", (F.col("row_idx") + 1).alias("start"))).withColumn("row_idx", F.col("start") - 1).drop("start")
    out = rows.join(by_row, ["sheet", "row_idx"]).join(steady, ["sheet", "row_idx"], "left")
    out = out.select("sheet", "row_idx", "label_density", (F.col("filled") / F.col("n_cols")).alias("fill"), (F.col("distinct") / F.col("filled")).alias("uniqueness"), F.coalesce("type_consistency", F.lit(0.0)).alias("type_consistency"), "vocabulary")
    return out.withColumn("score", sum(F.col(k) * w for k, w in HEADER_WEIGHTS.items()))


def detect_headers(candidates: DataFrame) -> DataFrame:
    """(sheet, header_row, score): the best candidate of each sheet that is good enough; the upper row wins a tie."""
    best = candidates.groupBy("sheet").agg(F.max_by(F.struct("row_idx", "score"), F.struct(F.round("score", 12), -F.col("row_idx"))).alias("x"))
    return best.select("sheet", F.col("x.row_idx").alias("header_row"), F.round("x.score", 3).alias("score")).filter(F.col("score") >= MIN_SCORE)


def sub_headers(grid: DataFrame, matches: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(sheet, row_idx) of the first rows whose next row is a second line of the header.

    Such a row is sparse beside the one above, all labels, and under a merged range (sheet, r0, c0, r1, c1) of it or naming a target.
    """
    top = grid.filter(F.col("row_idx") <= SCAN).join(matches, "value", "left")
    rows = top.groupBy("sheet", "row_idx").agg(F.count("*").alias("filled"), F.bool_and(_kind(top) == "text").alias("labels"), F.bool_or(F.col("target").isNotNull()).alias("named"))
    below = rows.select("sheet", (F.col("row_idx") - 1).alias("row_idx"), F.col("filled").alias("_filled"), "labels", "named")
    pairs = rows.select("sheet", "row_idx", "filled").join(below, ["sheet", "row_idx"]).filter((F.col("_filled") <= SPARSE * F.col("filled")) & F.col("labels"))
    if spans is None:
        return pairs.filter("named").select("sheet", "row_idx")
    wide = spans.filter("c1 > c0").select(F.col("sheet").alias("_sheet"), "r0", "c0", "r1", "c1")
    cells = top.select("sheet", (F.col("row_idx") - 1).alias("row_idx"), "col_idx")
    under = cells.join(wide, (F.col("sheet") == F.col("_sheet")) & F.col("row_idx").between(F.col("r0"), F.col("r1")) & F.col("col_idx").between(F.col("c0"), F.col("c1")))
    banner = under.select("sheet", "row_idx", F.lit(True).alias("banner")).distinct()
    return pairs.join(banner, ["sheet", "row_idx"], "left").filter("named or banner").select("sheet", "row_idx")


def header_blocks(grid: DataFrame, candidates: DataFrame, matches: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(sheet, header_row, composite, data_start, score): the header of each sheet that has one, from its top row on.

    The best candidate may be the second line of a header: as long as the row above is a candidate and has it as such, that one is
    taken. Data start at the next row that holds anything.
    """
    subs = sub_headers(grid, matches, spans).groupBy("sheet").agg(F.collect_set("row_idx").alias("_subs"))  # at most SCAN rows a sheet
    known = candidates.groupBy("sheet").agg(F.map_from_entries(F.collect_list(F.struct("row_idx", "score"))).alias("_scores"))
    found = detect_headers(candidates).select("sheet", "header_row").join(known, "sheet").join(subs, "sheet", "left")
    found = found.withColumn("_subs", F.coalesce("_subs", F.array().cast("array<int>")))
    climb = lambda row, _: F.when(F.map_contains_key("_scores", row - 1) & F.array_contains("_subs", row - 1), row - 1).otherwise(row)
    found = found.withColumn("header_row", F.aggregate(F.sequence(F.lit(1), F.lit(SCAN)), F.col("header_row"), climb))
    found = found.select("sheet", "header_row", F.array_contains("_subs", F.col("header_row")).alias("composite"), F.round(F.col("_scores")[F.col("header_row")], 3).alias("score"))
    after = F.col("row_idx") > F.col("header_row") + F.col("composite").cast("int")
    starts = grid.join(found, "sheet").groupBy("sheet").agg(F.min(F.when(after, F.col("row_idx"))).alias("_next"), F.max("n_rows").alias("_n"))
    return found.join(starts, "sheet").select("sheet", "header_row", "composite", F.coalesce("_next", "_n").alias("data_start"), "score")


def header_names(grid: DataFrame, blocks: DataFrame) -> DataFrame:
    """(sheet, col_idx, name) of every column: top and second line joined, a placeholder for none, (n) behind the n-th repeat."""
    if "composite" not in blocks.columns:
        blocks = blocks.withColumn("composite", F.lit(False))
    line = lambda k: F.max(F.when(F.col("row_idx") == F.col("header_row") + k, F.trim(F.regexp_replace("value", r"(?U)\s+", " "))))
    cells = grid.join(blocks.select("sheet", "header_row", "composite"), "sheet")
    lines = cells.filter(F.col("row_idx").between(F.col("header_row"), F.col("header_row") + F.col("composite").cast("int")))
    lines = lines.groupBy("sheet", "col_idx").agg(line(0).alias("_top"), line(1).alias("_sub"))
    columns = cells.groupBy("sheet").agg(F.max("n_cols").alias("_n")).select("sheet", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("col_idx"))
    both = F.when(normalise(F.col("_top")) == normalise(F.col("_sub")), F.col("_sub")).otherwise(F.concat("_top", F.lit(SEPARATOR), "_sub"))
    name = F.coalesce(both, "_sub", "_top", F.concat(F.lit("Unnamed_"), F.col("col_idx") + 1))
    row = columns.join(lines, ["sheet", "col_idx"], "left").select("sheet", "col_idx", name.alias("name"))
    again = F.row_number().over(Window.partitionBy("sheet", "name").orderBy("col_idx"))
    named = row.withColumn("_n", again).select("sheet", "col_idx", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.format_string("%s (%d)", "name", "_n")).alias("name"))
    # a name with (n) may be another column's own
    return named.withColumn("_n", again).select("sheet", "col_idx", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.format_string("%s [%d]", F.col("name"), F.col("col_idx") + 1)).alias("name"))


def region_quality(grid: DataFrame, starts: DataFrame) -> DataFrame:
    """(sheet, data_rows, null_ratio, row_continuity) of the rows from start on."""
    body = grid.join(starts, "sheet").filter("row_idx >= start")
    by_sheet = body.groupBy("sheet", "start", "n_rows", "n_cols").agg(F.countDistinct("row_idx").alias("data_rows"), F.count("*").alias("cells"))
    return by_sheet.select("sheet", "data_rows", (F.col("cells") / (F.col("data_rows") * F.col("n_cols"))).alias("null_ratio"), (F.col("data_rows") / (F.col("n_rows") - F.col("start"))).alias("row_continuity"))


def data_scale(rows: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.log10(rows + 1) / F.log10(F.lit(1.0 + FULL_SCALE))), 3)


def sheet_scores(grid: DataFrame, headers: DataFrame, matches: DataFrame) -> DataFrame:
    """The factors and score of every sheet."""
    sheets = grid.select("sheet").distinct().join(headers, "sheet", "left")
    starts = sheets.select("sheet", (F.coalesce("header_row", F.lit(-1)) + 1).alias("start"))
    known = grid.join(headers, "sheet").filter("row_idx = header_row").join(matches, "value").groupBy("sheet").agg((F.countDistinct("target") / N_TARGETS).alias("vocabulary_overlap"))
    out = sheets.join(region_quality(grid, starts), "sheet", "left").join(type_consistency(grid, starts).drop("start"), "sheet", "left").join(known, "sheet", "left")
    out = out.select("sheet", F.coalesce("data_rows", F.lit(0)).cast("long").alias("data_rows"), F.coalesce("score", F.lit(0.0)).alias("header_density"), *[F.round(F.coalesce(c, F.lit(0.0)), 3).alias(c) for c in ("type_consistency", "null_ratio", "row_continuity", "vocabulary_overlap")])
    out = out.withColumn("data_scale", data_scale(F.col("data_rows")))
    return out.withColumn("score", F.round(sum(F.col(k) * w for k, w in SHEET_WEIGHTS.items()), 3))


def classify_sheets(scores: DataFrame, file: str | None = None) -> DataFrame:
    """scores with class and confidence: of each file's sheets one is Primary; ranks need a file's handful of sheets only."""
    key = F.col(file) if file else F.lit(1)
    order = Window.partitionBy(key).orderBy(F.when(F.col("data_rows") >= 1, 0).otherwise(1), F.desc("score"), F.desc("data_rows"), "sheet")
    ranked = scores.withColumn("_rank", F.row_number().over(order)).withColumn("_next", F.lead(F.when(F.col("data_rows") >= 1, F.col("score"))).over(order))
    primary = (F.col("_rank") == 1) & (F.col("data_rows") >= 1)
    secondary = (F.col("score") >= 0.40) & (F.col("data_rows") >= 2) & (F.col("header_density") > 0) & (F.col("vocabulary_overlap") >= 0.15)
    margin = F.col("score") - F.coalesce("_next", F.lit(0.0))
    confidence = F.when(primary, F.col("score") + 0.5 * margin).when(secondary, F.col("score")).otherwise(1 - (0.7 * F.col("vocabulary_overlap") + 0.3 * F.col("score")))
    return ranked.withColumn("class", F.when(primary, "Primary").when(secondary, "Secondary").otherwise("Reject")).withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 3)).drop("_rank", "_next")
