"""Queries on profiles, mappings, sheets, memory, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmend import schema as S
from gridmend.operators import mapping as M
from gridmend.operators import memory, profile, sheets, vectors, verify
from gridmend.plans import oracle as O
from gridmend.plans import sheet_sql as SQL
from gridmend.plans.fixture import SOV_SQL, frame
from gridmend.plans.registry import YEAR, _sql, findings_of, on_frame, query
from gridmend.scratch import scratch, written
from gridmend.sources import grid as G
from gridmend.streaming import rules as stream_rules

FIELDS = O.COLS


_t = O.strip("value")
_digits = f"regexp_replace({_t}, '[^0-9.]', '', 'g')"
_n = f"(CASE WHEN regexp_matches({_t}, '^[\\s$£€]*\\(?-?[0-9,]+(\\.[0-9]+)?\\)?\\s*$') AND regexp_matches({_digits}, '[0-9]') THEN TRY_CAST({_digits} AS DOUBLE) * CASE WHEN regexp_matches({_t}, '^\\(|\\)$|^-') THEN -1 ELSE 1 END END)"
_marked = f"regexp_matches({_t}, '[$£€,]|\\.[0-9]')"
CLASS = f"""CASE WHEN value IS NULL OR {_t} = '' OR lower({_t}) IN {O.among(S.PROFILE_NULL_TOKENS)} THEN NULL
 WHEN lower({_t}) IN {O.among(profile.BOOLEANS)} THEN 'boolean' WHEN upper({_t}) IN {O.among(S.STATE_CODES + profile.PROVINCES)} THEN 'us_state'
 WHEN regexp_matches({_t}, '^[A-Za-z][0-9][A-Za-z]\\s?[0-9][A-Za-z][0-9]$') THEN 'zip'
 WHEN {_n} IS NOT NULL THEN CASE WHEN {_n} = floor({_n}) AND NOT {_marked} AND {_n} BETWEEN 1700 AND {YEAR + 2} AND length({_t}) = 4 THEN 'year' WHEN {_marked} OR {_n} <> floor({_n}) OR {_n} < 0 OR {_n} >= 100000 THEN 'currency' WHEN {_n} >= 100 THEN 'digits' ELSE 'small_int' END
 WHEN regexp_matches({_t}, '(?i)^[0-9]+[\\w\\-]*\\s+\\S+.*?\\b({profile.STREET})\\b') OR regexp_matches({_t}, '^[0-9]+\\s+[A-Za-z]') THEN 'street_address'
 WHEN regexp_matches({_t}, '^[A-Za-z][A-Za-z\\s.''\\-]{{1,40}}$') THEN 'place_name' WHEN regexp_matches({_t}, '^[\\w\\-/.]+$') THEN 'identifier' ELSE 'category' END"""
_LONG = "cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", sheet_row AS pos, {c} AS value FROM {{src}}" for c in FIELDS) + ")"
_ALL = _LONG.replace("{src}", "sov")
_FIRST = _ALL + f", shaped AS (SELECT *, {CLASS} AS shape FROM cells)"
_WIDTH = f"length(regexp_replace({_t}, '^0+', ''))"
_DIGITS = f"""dig AS (SELECT "column", CASE WHEN bool_or(length({_t}) IN (4, 5) AND starts_with({_t}, '0')) THEN 'zip' WHEN bool_or(CAST({_t} AS BIGINT) = 0) OR NOT bool_and({_WIDTH} IN (4, 5)) OR count(*) >= 3 AND bool_and(CAST({_t} AS BIGINT) % 100 = 0) OR max(CAST({_t} AS BIGINT)) / greatest(min(CAST({_t} AS BIGINT)), 1) > 120 THEN 'currency' ELSE 'zip' END AS digits_are FROM shaped WHERE shape = 'digits' GROUP BY "column")"""
_PROFILE = f"""w AS (SELECT "column", count(*) AS non_empty, round(count(DISTINCT lower({_t})) / count(*), 4) AS distinct_ratio FROM shaped WHERE shape IS NOT NULL GROUP BY "column"),
 prof AS (SELECT *, round(n / non_empty, 4) AS share FROM (SELECT "column", CASE WHEN shape = 'digits' THEN digits_are WHEN shape = 'place_name' AND non_empty >= 8 AND distinct_ratio <= 0.4 THEN 'category' ELSE shape END AS shape, non_empty, distinct_ratio, count(*) AS n, min(pos) AS first_pos
 FROM shaped LEFT JOIN dig USING ("column") JOIN w USING ("column") WHERE shape IS NOT NULL GROUP BY 1, 2, 3, 4))"""
_SHAPES = "ts(target, shape, weight) AS (VALUES " + ", ".join(f"({O.quoted(t)}, '{s}', {1.0 if k == 0 else 0.6})" for t, found in profile.TARGET_SHAPES.items() for k, s in enumerate(found)) + ")"
_FP = """fp AS (SELECT c."column", ts.target, CASE WHEN c.non_empty < 3 THEN 0.0 ELSE round(least(CAST(sum(coalesce(n, 0) * weight / c.non_empty) AS DOUBLE), 1.0), 4) END AS fingerprint, c.non_empty < 3 AS abstained FROM (SELECT DISTINCT "column", non_empty FROM prof) c CROSS JOIN ts LEFT JOIN prof p ON p."column" = c."column" AND p.shape = ts.shape GROUP BY c."column", ts.target, c.non_empty)"""


def _cells(df: DataFrame) -> DataFrame:
    return profile.cells(df, FIELDS)


on_frame("classify_value", O.with_(f'SELECT "column", pos, {CLASS} AS shape FROM cells', _ALL))(
    lambda df: profile.classified(_cells(df), YEAR).select("column", "pos", "shape")
)
on_frame("resolve_digits", O.with_("SELECT * FROM dig", _FIRST, _DIGITS))(lambda df: profile.resolve_digits(_cells(df), YEAR))
on_frame("profile_column", O.with_("SELECT * FROM prof", _FIRST, _DIGITS, _PROFILE))(lambda df: profile.profile(_cells(df), YEAR))
on_frame("dominant_shape", O.with_('SELECT "column", shape, share FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, first_pos) AS k FROM prof) WHERE k = 1', _FIRST, _DIGITS, _PROFILE))(lambda df: profile.dominant(profile.profile(_cells(df), YEAR)))
on_frame("fingerprint_score", O.with_("SELECT * FROM fp", _FIRST, _DIGITS, _PROFILE, _SHAPES, _FP))(lambda df: profile.fingerprint(profile.profile(_cells(df), YEAR)))

# scores that the orders' own figures stand for: two channels in 0..1, one of them silent for some orders
_CH = "ch AS (SELECT o_orderkey, (o_orderkey % 101) / 103.0::DOUBLE AS lex, (o_custkey % 97) / 107.0::DOUBLE AS fin, o_orderkey % 7 = 0 AS silent FROM orders), fu AS (SELECT *, round((0.3 * lex + CASE WHEN silent THEN 0 ELSE 0.35 * fin END)::DOUBLE / (0.3 + CASE WHEN silent THEN 0 ELSE 0.35 END)::DOUBLE, 4) AS fused FROM ch)"


def _channels(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    ch = o.select("o_orderkey", ((F.col("o_orderkey") % 101) / 103.0).alias("lex"), ((F.col("o_custkey") % 97) / 107.0).alias("fin"), (F.col("o_orderkey") % 7 == 0).alias("silent"))
    return ch.withColumn("fused", M.fuse(F.col("lex"), F.col("fin"), F.col("silent")))


query("fuse_scores", f"WITH {_CH} SELECT o_orderkey, fused FROM fu")(lambda spark, d: _channels(spark, d).select("o_orderkey", "fused"))
query("margin_confidence", "WITH x AS (SELECT o_orderkey, (o_orderkey % 101)::DOUBLE / 100 AS fused, (o_custkey % 47 - 5)::DOUBLE / 97 AS margin FROM orders) SELECT o_orderkey, round(fused * (1 - 0.35::DOUBLE * (1 - least(greatest(margin, 0) / 0.2::DOUBLE, 1))), 4) AS confidence FROM x")(
    lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", M.margin_confidence((F.col("o_orderkey") % 101).cast("double") / 100, (F.col("o_custkey") % 47 - 5).cast("double") / 97).alias("confidence"))
)
query("flag_bands", "SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 OR o_orderkey % 101 < 50 THEN 'required' WHEN o_orderkey % 101 >= 85 THEN 'auto' ELSE 'suggested' END AS flag FROM orders")(
    lambda spark, d: spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", M.review_flag((F.col("o_orderkey") % 101).cast("double") / 100, F.when(F.col("o_custkey") % 11 != 0, "City")).alias("flag"))
)

# a workbook whose sheets are the nations' customers: a title, a blank row, a header, then the schedule
HEADERS = ["Loc #", "Street Address", "City", "St", "Zip", "Bldg Value", "Contents", "Stories", "Yr Built"]
_GRID_COLS = ["reference", "address", "city", "state", "zip", "building_value", "contents", "storeys", "year_built"]
_GRID_DUCK = f"""WITH sov AS ({SOV_SQL.replace('{source}', 'customer')}), body AS (SELECT CAST(c_nationkey AS STRING) AS sheet, CAST(2 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS row_idx, sov.* FROM sov JOIN customer ON sheet_row = c_custkey + 2),
 cells AS (SELECT DISTINCT sheet, 0 AS row_idx, 0 AS col_idx, 'Schedule of nation ' || sheet AS value FROM body UNION ALL {' UNION ALL '.join(f"SELECT DISTINCT sheet, 2, {k}, '{h}' FROM body" for k, h in enumerate(HEADERS))} UNION ALL {' UNION ALL '.join(f"SELECT sheet, row_idx, {k}, {c} FROM body" for k, c in enumerate(_GRID_COLS))})"""


def cells_of(spark: SparkSession, d: str) -> DataFrame:
    """The workbook's cells, from one pass over the schedule; a sheet's first row brings its title and header."""
    nation = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") + 2).cast("long").alias("sheet_row"), F.col("c_nationkey").cast("string").alias("sheet"))
    place = F.row_number().over(Window.partitionBy("sheet").orderBy("sheet_row"))
    body = frame(spark, d).join(nation, "sheet_row").withColumn("row_idx", place + 2)
    cell = lambda row, col, value: F.struct(row.alias("row_idx"), F.lit(col).alias("col_idx"), value.alias("value"))
    own = F.array(*[cell(F.col("row_idx"), k, F.col(c)) for k, c in enumerate(_GRID_COLS)])
    head = F.array(cell(F.lit(0), 0, F.concat(F.lit("Schedule of nation "), F.col("sheet"))), *[cell(F.lit(2), k, F.lit(h)) for k, h in enumerate(HEADERS)])
    return body.select("sheet", F.inline(F.when(F.col("row_idx") == 3, F.concat(own, head)).otherwise(own)))


_FILLED = "g AS (SELECT * FROM (SELECT *, max(row_idx) OVER (PARTITION BY sheet) + 1 AS n_rows, max(col_idx) OVER (PARTITION BY sheet) + 1 AS n_cols FROM cells WHERE value IS NOT NULL AND trim(value) <> ''))"
query("trim_grid", f"{_GRID_DUCK}, {_FILLED} SELECT sheet, row_idx, col_idx, value, n_rows, n_cols FROM g")(lambda spark, d: sheets.trim_grid(cells_of(spark, d)).select("sheet", "row_idx", "col_idx", "value", "n_rows", "n_cols"))
_k = O.strip("value")
_KIND = f"CASE WHEN regexp_matches({_k}, '^[(\\-+]?\\s*[$€£¥]?\\s*[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\\.[0-9]+)?\\s*%?\\s*\\)?$|^[(\\-+]?\\s*[$€£¥]?\\s*[0-9]+(?:\\.[0-9]+)?\\s*%?\\s*\\)?$') THEN 'number' ELSE 'text' END"
_STEADY = f"SELECT sheet, round(avg(share), 6) AS type_consistency FROM (SELECT sheet, col_idx, max(n) / sum(n) AS share FROM (SELECT sheet, col_idx, {_KIND} AS kind, count(*) AS n FROM g WHERE row_idx >= 3 GROUP BY ALL) GROUP BY sheet, col_idx) GROUP BY sheet"
query("type_consistency", f"{_GRID_DUCK}, {_FILLED} {_STEADY}")(
    lambda spark, d: sheets.type_consistency(g := sheets.trim_grid(cells_of(spark, d)), g.select("sheet", F.lit(3).alias("start")).distinct()).select("sheet", F.round("type_consistency", 6).alias("type_consistency"))
)
query("region_quality", f"{_GRID_DUCK}, {_FILLED} SELECT sheet, data_rows, round(cells / (data_rows * n_cols), 6) AS null_ratio, round(data_rows / (n_rows - 3), 6) AS row_continuity FROM (SELECT sheet, n_rows, n_cols, count(DISTINCT row_idx) AS data_rows, count(*) AS cells FROM g WHERE row_idx >= 3 GROUP BY ALL)")(
    lambda spark, d: sheets.region_quality(g := sheets.trim_grid(cells_of(spark, d)), g.select("sheet", F.lit(3).alias("start")).distinct()).select("sheet", "data_rows", F.round("null_ratio", 6).alias("null_ratio"), F.round("row_continuity", 6).alias("row_continuity"))
)
query("data_scale", f"{_GRID_DUCK} SELECT sheet, round(least(1.0, log10(count(DISTINCT row_idx) + 1) / log10(1001)), 3) AS data_scale FROM cells WHERE row_idx >= 3 GROUP BY sheet")(
    lambda spark, d: cells_of(spark, d).filter("row_idx >= 3").groupBy("sheet").agg(F.countDistinct("row_idx").alias("n")).select("sheet", sheets.data_scale(F.col("n")).alias("data_scale"))
)
query("merge_fill", f"{_GRID_DUCK} SELECT sheet, row_idx, col_idx, CASE WHEN row_idx = 0 THEN 'Schedule of nation ' || sheet ELSE value END AS value FROM cells WHERE row_idx > 0 UNION ALL SELECT DISTINCT sheet, 0, k, 'Schedule of nation ' || sheet FROM cells, range(0, 4) t(k)")(
    lambda spark, d: sheets.merge_fill(c := cells_of(spark, d), c.select("sheet", F.lit(0).alias("r0"), F.lit(0).alias("c0"), F.lit(0).alias("r1"), F.lit(3).alias("c1")).distinct())
)


# the same schedules, but each nation's sheet has its header elsewhere, in other words and in another order, a third of them in two lines
_WORDS = [HEADERS, ["Location ID", "Address Line 1", "Town", "Province", "Postal Code", "Building Limit", "Contents Limit", "Floors", "Year Constructed"]]
_VALUES = (5, 6)


def varied_cells(spark: SparkSession, d: str) -> DataFrame:
    """Titles in rows 0 to n - 1, the header in row n, for nation n; a last column has no header."""
    nation = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") + 2).cast("long").alias("sheet_row"), F.col("c_nationkey").cast("int").alias("n"))
    place = F.row_number().over(Window.partitionBy("n").orderBy("sheet_row"))
    two = (F.col("n") % 3 == 0).cast("int")
    body = frame(spark, d).join(nation, "sheet_row").withColumn("row_idx", place + F.col("n") + two)
    cell = lambda row, col, value: F.struct(row.cast("int").alias("row_idx"), col.cast("int").alias("col_idx"), value.cast("string").alias("value"))
    at = lambda k: (F.lit(k) + F.col("n")) % 9
    name = lambda k: F.when(F.col("n") % 2 == 0, _WORDS[0][k]).otherwise(_WORDS[1][k])
    own = F.array(*[cell(F.col("row_idx"), at(k), F.col(c)) for k, c in enumerate(_GRID_COLS)], cell(F.col("row_idx"), F.lit(9), F.lit("see file")))
    top = [cell(F.col("n"), at(k), F.when(two == 1, "Values").otherwise(name(k)) if k in _VALUES else name(k)) for k in range(9)]
    sub = F.when(two == 1, F.array(*[cell(F.col("n") + 1, at(k), name(k)) for k in _VALUES])).otherwise(F.array().cast("array<struct<row_idx:int,col_idx:int,value:string>>"))
    titles = F.transform(F.filter(F.sequence(F.lit(0), F.col("n")), lambda r: r < F.col("n")), lambda r: cell(r, F.lit(0), F.concat(F.lit("Part "), r.cast("string"))))
    first = F.col("row_idx") == F.col("n") + two + 1
    return body.select(F.col("n").cast("string").alias("sheet"), F.inline(F.when(first, F.concat(own, F.array(*top), sub, titles)).otherwise(own)))


_SHEETS = "s AS (SELECT DISTINCT c_nationkey AS n, c_nationkey % 3 = 0 AS composite FROM customer), k AS (SELECT n, composite, (k + n) % 9 AS col_idx, k, target, CASE WHEN n % 2 = 0 THEN a ELSE b END AS h FROM s, (VALUES " + ", ".join(f"({k}, '{a}', '{b}', '{t}')" for k, (a, b, t) in enumerate(zip(*_WORDS, ["Reference", "Address", "City", "State", "Zip", "Building Value", "Contents", "Storeys", "Year Built"]))) + ") x(k, a, b, target))"


def _matches(spark: SparkSession, grid: DataFrame) -> DataFrame:
    return M.match_target(grid.filter(F.col("row_idx") < sheets.SCAN).select("value"), M.glossary_rows())


def _located(spark: SparkSession, d: str):
    """(grid, matches, header blocks) of the varied sheets, each written, as several steps read them."""
    grid = written(sheets.trim_grid(varied_cells(spark, d)), "grid")
    matches = written(_matches(spark, grid), "matches")
    spans = grid.filter("col_idx = 0").select("sheet", F.lit(-1).alias("r0"), F.lit(0).alias("c0"), F.lit(-1).alias("r1"), F.lit(0).alias("c1")).distinct()
    return grid, matches, written(sheets.header_blocks(grid, written(sheets.header_candidates(grid, matches), "candidates"), matches, spans), "blocks")


_TOP = f"row_idx < {sheets.SCAN}"
query("match_target", f"{_GRID_DUCK}, g AS (SELECT * FROM cells WHERE value IS NOT NULL), {SQL.matches(_TOP)} SELECT value, target FROM m")(lambda spark, d: _matches(spark, cells_of(spark, d)))
_FACTORS = ["label_density", "fill", "uniqueness", "type_consistency", "vocabulary", "score"]
query("header_candidates", f"{_GRID_DUCK}, {_FILLED}, {SQL.matches(_TOP)}, {SQL.CANDIDATES} SELECT sheet, row_idx, {', '.join(f'round({c}, 6) AS {c}' for c in _FACTORS)} FROM ca")(
    lambda spark, d: sheets.header_candidates(g := sheets.trim_grid(cells_of(spark, d)), _matches(spark, g)).select("sheet", "row_idx", *[F.round(c, 6).alias(c) for c in _FACTORS])
)
query("detect_headers", f"WITH {_SHEETS} SELECT CAST(n AS VARCHAR) AS sheet, n AS header_row, composite, n + CASE WHEN composite THEN 2 ELSE 1 END AS data_start FROM s")(lambda spark, d: _located(spark, d)[2].select("sheet", "header_row", "composite", "data_start"))
query("header_names", f"WITH {_SHEETS} SELECT CAST(n AS VARCHAR) AS sheet, col_idx, CASE WHEN composite AND k IN (5, 6) THEN 'Values › ' || h ELSE h END AS name FROM k UNION ALL SELECT CAST(n AS VARCHAR), 9, 'Unnamed_10' FROM s")(
    lambda spark, d: (lambda g, m, h: sheets.header_names(g, h))(*_located(spark, d))
)
_SCORED = f"WITH {SQL.varied(SOV_SQL.replace('{source}', 'customer'), _GRID_COLS, _WORDS, _VALUES)}, {_FILLED}, {SQL.matches(_TOP)}, {SQL.CANDIDATES}, {SQL.SCORES}"
query("sheet_scores", f"{_SCORED} SELECT * FROM ss")(lambda spark, d: (lambda g, m, h: sheets.sheet_scores(g, h, m))(*_located(spark, d)))
query("classify_sheets", f"{_SCORED} {SQL.CLASSES}")(lambda spark, d: (lambda g, m, h: sheets.classify_sheets(sheets.sheet_scores(g, h, m)).select("sheet", "class", "confidence", "score"))(*_located(spark, d)))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for every column of every sheet: header against glossary, all values against shapes."""
    grid, _, blocks = _located(spark, d)
    heads = sheets.header_names(grid, blocks).select("sheet", F.col("col_idx").alias("column_idx"), F.col("name").alias("header"))
    body = grid.join(blocks.select("sheet", "data_start"), "sheet").filter("row_idx >= data_start").select("sheet", F.col("col_idx").alias("column_idx"), F.col("row_idx").alias("pos"), "value")
    return written(M.build_evidence(heads, body, M.glossary_rows(), YEAR), "evidence")


# header phrases with a letter missing, every third with a word more: what no header of the schedules has
_ALL_PHRASES = [p for _, _, p, _ in M.glossary_rows()]
_MISSPELT = f"""SELECT DISTINCT concat(substr(w, 1, lost), substr(w, lost + 2), CASE WHEN p_partkey % 3 = 0 THEN ' ' || string_split(p_name, ' ')[1] ELSE '' END) AS header
 FROM (SELECT *, CAST((p_partkey // {len(_ALL_PHRASES)}) % length(w) AS INT) AS lost FROM (SELECT *, [{", ".join(map(O.quoted, _ALL_PHRASES))}][p_partkey % {len(_ALL_PHRASES)} + 1] AS w FROM part))"""


def misspelt(spark: SparkSession, d: str) -> DataFrame:
    key, n = F.col("p_partkey"), len(_ALL_PHRASES)
    part = spark.read.parquet(f"{d}/part.parquet").withColumn("w", F.get(F.array(*map(F.lit, _ALL_PHRASES)), (key % n).cast("int")))
    at = F.expr(f"cast(p_partkey div {n} % length(w) as int)")
    more = F.when(key % 3 == 0, F.concat(F.lit(" "), F.split("p_name", " ")[0])).otherwise("")
    return part.select(F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2), more).alias("header")).distinct()


query("misspelt_headers", f"WITH hs AS ({_MISSPELT}), {SQL.LEXICAL} SELECT * FROM lx")(lambda spark, d: M.lexical(misspelt(spark, d), M.glossary_rows()))
query("misspelt_texts")(lambda spark, d: M.match_target(misspelt(spark, d).select(F.col("header").alias("value")), M.glossary_rows()))
query("lexical_match", f"{_GRID_DUCK}, hs AS (SELECT value AS header FROM cells WHERE row_idx = 2 AND value IS NOT NULL), {SQL.LEXICAL} SELECT * FROM lx")(lambda spark, d: M.lexical(cells_of(spark, d).filter("row_idx = 2").select(F.col("value").alias("header")), M.glossary_rows()))
query("assign", f"WITH {_SHEETS} SELECT CAST(n AS VARCHAR) AS sheet, col_idx AS column_idx, target FROM k UNION ALL SELECT CAST(n AS VARCHAR), 9, NULL FROM s")(lambda spark, d: M.assign(_evidence(spark, d)).select("sheet", "column_idx", "target"))
query("map_columns", f"WITH {_SHEETS} SELECT CAST(n AS VARCHAR) AS sheet, col_idx AS column_idx, target, CASE WHEN composite AND k IN (5, 6) THEN 'fused' ELSE 'exact' END AS method FROM k UNION ALL SELECT CAST(n AS VARCHAR), 9, NULL, 'unresolved' FROM s")(
    lambda spark, d: M.map_columns(_evidence(spark, d)).select("sheet", "column_idx", "target", "method")
)
query("mapping_block", f"WITH {_SHEETS} SELECT CAST(n AS VARCHAR) AS sheet, CAST(9 AS BIGINT) AS resolved, CAST(1 AS BIGINT) AS unresolved FROM s")(lambda spark, d: M.mapping_block(M.map_columns(_evidence(spark, d))).select("sheet", "resolved", "unresolved"))
query("mapping_confidence")(lambda spark, d: M.mapping_block(M.map_columns(_evidence(spark, d))))
query("unmapped_targets", f"WITH {_SHEETS} SELECT CAST(n AS VARCHAR) AS sheet, t AS target FROM s, (VALUES " + ", ".join(f"({O.quoted(t)})" for t in S.FIELD_NAMES) + ") x(t) WHERE t NOT IN (SELECT target FROM k)")(lambda spark, d: M.unmapped_targets(M.map_columns(_evidence(spark, d))))


@query("mapping_issues", f"WITH {_SHEETS} SELECT CAST(n AS VARCHAR) AS sheet, rule, CAST(NULL AS VARCHAR) AS field, severity FROM s, (VALUES ('mapping_requires_review', 'High'), ('semantic_channel_unavailable', 'Medium')) x(rule, severity)")
def mapping_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues that don't depend on how close scores are: the column without a header, and the channel that is not there."""
    mappings = written(M.map_columns(_evidence(spark, d)), "mappings")
    return M.mapping_issues(mappings, mappings, model=True).filter("field is null")




_TWENTIETH = "q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query_id, vec_id, round(list_cosine_similarity(query::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM embeddings, q)"


def _queries_of(rows: DataFrame) -> DataFrame:
    return rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("nearest_decisions", f"WITH {_TWENTIETH} SELECT query_id, vec_id, rank, round(similarity, 4) AS similarity FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM p) WHERE rank <= 5")
def nearest_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return memory.nearest(_queries_of(rows), rows).withColumn("similarity", F.round("similarity", 4))


_MEANS = "q AS (SELECT label AS query_id, list(m ORDER BY i) AS query FROM (SELECT label, i, avg(e) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label), p AS (SELECT query_id, vec_id, round(list_cosine_similarity(query, embedding::DOUBLE[]), 6) AS similarity FROM embeddings, q)"


def _means(rows: DataFrame) -> DataFrame:
    """(query_id, query): the mean of all vectors of each label, of which there are few."""
    places = rows.select("label", F.posexplode("embedding").alias("i", "e")).groupBy("label", "i").agg(F.avg(F.col("e").cast("double")).alias("m"))
    return places.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("query"))


@query("semantic_matrix", f"WITH {_MEANS} SELECT query_id, vec_id, round(greatest(0.0, least(1.0, (similarity - 0.35) / 0.45)), 4) AS score FROM p")
def semantic_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every row beside the mean of every label, as a header is scored beside every target's description."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    pairs = memory.compare(written(_means(rows), "means"), rows)
    return pairs.select("query_id", "vec_id", memory.calibrate(F.round(memory.cosine(F.col("query"), F.col("embedding")), 6)).alias("score"))


def _indexed(spark: SparkSession, rows: DataFrame) -> tuple[str, vectors.Lists]:
    """An index into which every row came twice: first, for every other one, with its vector turned round, then as it is."""
    lists, path = vectors.fit(rows), scratch(spark, "vectors")
    turned = rows.filter("vec_id % 2 = 1").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    vectors.upsert(path, turned, lists)
    vectors.upsert(path, rows, lists)
    return path, lists


@query("vector_index", _sql["nearest_decisions"])
def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """The exact search of an index after an upsert."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    path, lists = _indexed(spark, rows)
    return vectors.search(vectors.read(spark, path), _queries_of(rows), lists).withColumn("similarity", F.round("similarity", 4))


@query("vector_search")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The search of half of the lists, as these vectors have no clusters; a test measures its recall over the same queries."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    path, lists = _indexed(spark, rows)
    return vectors.search(vectors.read(spark, path), _queries_of(rows), lists, probes=-(-len(lists.centroids) // 2)).withColumn("similarity", F.round("similarity", 4))


_NUMS = "list_distinct(list_transform(list_filter(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?%?'), lambda x: NOT ends_with(x, '%')), lambda x: replace(x, ',', '')))"
query("number_trace", f"SELECT doc_id, CAST(len(list_filter({_NUMS}, lambda x: x NOT IN (CAST(doc_id AS VARCHAR), CAST(n_chars AS VARCHAR)))) AS INT) AS n_untraceable FROM documents")(
    lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(verify.untraceable(F.col("text"), F.array(F.col("doc_id").cast("string"), F.col("n_chars").cast("string")))).alias("n_untraceable"))
)


@query("harness_metrics", O.on_findings("SELECT 'DQ-10' AS rule, count(*) AS injected, count(*) AS found, 1.0::DOUBLE AS recall FROM customer WHERE c_custkey % 13 IN (0, 1, 6) UNION ALL SELECT 'DQ-05', count(*), count(*), 1.0 FROM customer WHERE c_custkey % 14 = 2 UNION ALL SELECT 'DQ-02', count(*), count(*), 1.0 FROM customer WHERE c_custkey % 13 = 4"))
def harness_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Defects put into the schedule against findings on their cells."""
    df = frame(spark, d)
    key = F.col("sheet_row") - 2
    injected = df.select("sheet_row", F.explode(F.array_compact(F.array(F.when((key % 13).isin(0, 1, 6), "DQ-10"), F.when(key % 14 == 2, "DQ-05"), F.when(key % 13 == 4, "DQ-02")))).alias("rule"))
    found = findings_of(df).select("sheet_row", "rule").distinct().withColumn("hit", F.lit(1))
    both = injected.join(found, ["sheet_row", "rule"], "left").groupBy("rule").agg(F.count("*").alias("injected"), F.count("hit").alias("found"))
    return both.withColumn("recall", F.col("found") / F.col("injected"))


@query("csv_cells", O.with_("SELECT CAST((c_custkey % 4) AS INT) AS part, count(*) * 5 AS cells FROM customer GROUP BY ALL"))
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    """The schedule written as CSV files that a reader takes whole and read back as cells; a file that is not is an error."""
    path = scratch(spark, "csv")
    rows = frame(spark, d).withColumn("part", (F.col("sheet_row") - 2) % 4)
    rows.select("part", "sheet_row", "address", F.coalesce("reference", F.lit("")).alias("reference"), "storeys", "construction").write.option("maxRecordsPerFile", G.MAX_ROWS - 1).partitionBy("part").csv(path)
    cells = G.read_workbooks(spark, path + "/part=*", G.MAX_ROWS)
    cells = cells.filter("kind <> 'error' or value <> 'the file is empty'")  # Spark writes one for an empty partition
    lost = F.when(F.col("kind") != "cell", F.raise_error(F.concat_ws(" ", "kind", "path", "value")))
    cells = cells.withColumn("kind", F.coalesce(lost, "kind"))
    return cells.filter("kind = 'cell'").groupBy(F.regexp_extract("path", "part=([0-9]+)", 1).cast("int").alias("part")).agg(F.count("*").alias("cells"))


@query("stream_findings", O.with_("SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(O.RULES[r] for r in ("DQ-01", "DQ-02", "DQ-03", "DQ-04", "DQ-05", "DQ-06", "DQ-07", "DQ-08", "DQ-09", "DQ-10", "DQ-11", "DQ-14", "DQ-18")) + ") GROUP BY rule"))
def stream_findings(spark: SparkSession, d: str) -> DataFrame:
    """The rules on one row over the schedule as a stream."""
    folder, out = scratch(spark, "arriving"), scratch(spark, "findings")
    frame(spark, d).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream_rules.run_once(stream_rules.local_findings(spark.readStream.schema(schema).parquet(folder), YEAR), out, scratch(spark, "offsets"))
    return spark.read.parquet(out).groupBy("rule").agg(F.count("*").alias("n"))


@query("duplicate_groups", O.with_(f"SELECT address_key, zip_key, count(*) AS members, count(ref) = count(*) AND count(DISTINCT ref) = count(*) AS distinct_references FROM (SELECT CASE WHEN {O.null('address')} THEN '' ELSE {O.ADDRESS.replace('{0}', 'address')} END AS address_key, CASE WHEN {O.null('zip')} THEN '' ELSE substr(regexp_replace(zip, '[^0-9]', '', 'g'), 1, 5) END AS zip_key, CASE WHEN NOT {O.null('reference')} THEN {O.strip('reference')} END AS ref FROM c) WHERE address_key <> '' GROUP BY ALL HAVING count(*) > 1"))
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    from gridmend.operators import rules

    return rules.duplicate_groups(frame(spark, d))


@query("header_suffix", "SELECT p_brand AS sheet, p_partkey AS col_idx, CASE WHEN n = 1 THEN p_type ELSE p_type || ' (' || n || ')' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)")
def header_suffix(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each brand as the header of a sheet; columns that no part has are left out."""
    p = spark.read.parquet(f"{d}/part.parquet")
    grid = sheets.trim_grid(p.select(F.col("p_brand").alias("sheet"), F.lit(0).alias("row_idx"), F.col("p_partkey").cast("int").alias("col_idx"), F.col("p_type").alias("value")))
    names = sheets.header_names(grid, grid.select("sheet", F.lit(0).alias("header_row")).distinct())
    return names.filter("name not like 'Unnamed~_%' escape '~'").withColumn("col_idx", F.col("col_idx").cast("long"))
