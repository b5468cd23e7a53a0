"""All queries on the schedule, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend import schema as S
from gridmend.functions import clean as C
from gridmend.operators import frame as FR
from gridmend.operators import review, rules, score, transform
from gridmend.plans import oracle as O
from gridmend.plans.fixture import frame
from gridmend.scratch import written

YEAR = O.YEAR
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def on_frame(name: str, sql: str | None = None):
    """A query on the schedule; the function gets the frame."""
    return lambda f: query(name, sql)(lambda spark, sf_dir: f(frame(spark, sf_dir)))


def findings_of(df: DataFrame) -> DataFrame:
    return rules.run_rules(df, YEAR, reconciled=True)


on_frame("sov_frame", O.with_(f"SELECT sheet_row, {', '.join(O.COLS)} FROM sov"))(lambda df: df.select("sheet_row", *O.COLS))
on_frame("is_null", O.with_(" UNION ALL ".join(f"SELECT sheet_row, '{c}' AS field FROM sov WHERE {O.null(c)}" for c in O.COLS)))(
    lambda df: df.select("sheet_row", F.explode(F.array_compact(F.array(*[F.when(C.is_null(c), F.lit(c)) for c in O.COLS]))).alias("field"))
)


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"c_{c}.value").alias("value"), F.col(f"c_{c}.status").alias("status"), F.col(f"c_{c}.removed").alias("removed")) for c in columns])
    return FR.with_clean(df).select("sheet_row", F.inline(cells))


_amounts = lambda columns: O.with_(" UNION ALL ".join(f"SELECT sheet_row, '{c}' AS field, v_{c} AS value, s_{c} AS status, CASE WHEN s_{c} = 'reformatted' THEN r_{c} ELSE '' END AS removed FROM c" for c in columns))
on_frame("clean_amount", _amounts(O.AMOUNTS))(lambda df: _long(df, O.AMOUNTS))
on_frame("clean_integer", _amounts(O.INTEGERS))(lambda df: _long(df, O.INTEGERS))
_texts = ["reference", "address", "city", "state", "occupancy", "construction", "sprinklers"]
on_frame("clean_text", O.with_("SELECT sheet_row, " + ", ".join(f"CASE WHEN NOT {O.null(c)} THEN {O.strip(c)} END AS {c}" for c in _texts) + " FROM sov"))(
    lambda df: df.select("sheet_row", *[C.clean_text(c).alias(c) for c in _texts])
)
on_frame(
    "typed_frame",
    O.with_("SELECT sheet_row, " + ", ".join(f"{O.usable(c)} AS {c}" for c in O.AMOUNTS) + ", " + ", ".join(f"CAST({O.usable(c)} AS BIGINT) AS {c}" for c in O.INTEGERS) + ", " + ", ".join(f"CASE WHEN NOT {O.null(c)} THEN {O.strip(c)} END AS {c}" for c in _texts) + " FROM c"),
)(lambda df: FR.typed(df))
_kind = "CASE WHEN {0} IS NULL OR {1} = '' THEN 'empty' WHEN regexp_matches({1}, '^[(\\-+]?\\s*[$€£¥]?\\s*[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\\.[0-9]+)?\\s*%?\\s*\\)?$|^[(\\-+]?\\s*[$€£¥]?\\s*[0-9]+(?:\\.[0-9]+)?\\s*%?\\s*\\)?$') THEN 'number' ELSE 'text' END"
on_frame("cell_kind", O.with_("SELECT sheet_row, " + ", ".join(f"{_kind.format(c, O.strip(c))} AS {c}" for c in O.COLS) + " FROM sov"))(lambda df: df.select("sheet_row", *[C.cell_kind(F.col(c)).alias(c) for c in O.COLS]))
query("normalise_header", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS header FROM part")(
    lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", C.normalise(F.concat_ws(" / ", "p_name", "p_brand")).alias("header"))
)
on_frame("normalise_address", O.with_(f"SELECT sheet_row, {O.ADDRESS.replace('{0}', 'address')} AS address_key FROM sov"))(lambda df: df.select("sheet_row", C.normalise_address(F.col("address")).alias("address_key")))
on_frame("frame_construction", O.with_(f"SELECT sheet_row, {O.FRAME.replace('{0}', 'construction')} AS is_frame FROM sov"))(lambda df: df.select("sheet_row", C.is_frame(F.col("construction")).alias("is_frame")))
on_frame("date_shape", O.with_(f"SELECT sheet_row, {O.SHAPE.replace('{0}', 'year_built')} AS shape FROM sov"))(lambda df: df.select("sheet_row", C.date_shape(F.col("year_built")).alias("shape")))
on_frame("state_lookup", O.with_("SELECT sheet_row, code FROM c"))(lambda df: df.select("sheet_row", C.state_code(F.col("state")).alias("code")))


def zip_dim(spark: SparkSession) -> DataFrame:
    """(state, lo, hi) of the fixed ranges: 77 rows."""
    return spark.createDataFrame([(s, lo, hi) for s, found in S.ZIP_RANGES.items() for lo, hi in found], "st string, lo int, hi int")


def _prefixes(df: DataFrame) -> DataFrame:
    text = C.zip_compact(F.col("zip"))
    return df.select("sheet_row", C.state_code(F.col("state")).alias("code"), F.when(text.rlike("^[0-9]{5}$"), F.substring(text, 1, 3)).try_cast("int").alias("prefix")).filter("prefix is not null")


_PREFIX = "p AS (SELECT sheet_row, code, CAST(CASE WHEN regexp_matches(zc, '^[0-9]{5}$') THEN substr(zc, 1, 3) END AS INT) AS prefix FROM c WHERE regexp_matches(zc, '^[0-9]{5}$'))"


@query("zip_prefix_join", O.with_("SELECT sheet_row, code, prefix, lo, hi FROM p LEFT JOIN zips ON st = code AND prefix BETWEEN lo AND hi", _PREFIX))
def zip_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prefixes(frame(spark, sf_dir))
    return rows.join(F.broadcast(zip_dim(spark)), (F.col("st") == F.col("code")) & F.col("prefix").between(F.col("lo"), F.col("hi")), "left").drop("st")


@query("zip_owner_join", O.with_("SELECT sheet_row, prefix, array_to_string(list_sort(list(DISTINCT st)), ',') AS owners FROM p JOIN zips ON prefix BETWEEN lo AND hi GROUP BY sheet_row, prefix", _PREFIX))
def zip_owner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range join becomes an equal one over the thousand possible prefixes."""
    owners = zip_dim(spark).select(F.explode(F.sequence("lo", "hi")).alias("prefix"), "st").groupBy("prefix").agg(F.array_join(F.sort_array(F.collect_set("st")), ",").alias("owners"))
    return _prefixes(frame(spark, sf_dir)).join(F.broadcast(owners), "prefix").select("sheet_row", "prefix", "owners")


for _rule, _text in O.RULES.items():
    on_frame(_rule.lower().replace("-", ""), O.with_(_text, O.S17))(lambda df, r=_rule: rules.run_rules(df, YEAR, [r]))

# DQ-15 needs a totals row, DQ-16 a stated total: both are derived from the schedule's own sums
_SUMS = "sums AS (SELECT " + ", ".join(f"sum(v_{c}) AS {c}" for c in O.AMOUNTS) + " FROM c)"
_whole = lambda c: f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"


def _with_total(df: DataFrame) -> DataFrame:
    sums = FR.with_clean(df).agg(*[F.sum(f"c_{c}.value").cast("long").cast("string").alias(c) for c in O.AMOUNTS])
    return df.unionByName(sums.select(F.lit(1).cast("long").alias("sheet_row"), F.lit("Grand Total").alias("reference"), *O.AMOUNTS), allowMissingColumns=True)


on_frame("dq15", O.with_("SELECT 'DQ-15' AS rule, CAST(1 AS BIGINT) AS sheet_row, CAST(NULL AS VARCHAR) AS field, 'High' AS severity, 'Grand Total' AS before, CAST(NULL AS VARCHAR) AS after, 'exclude_row' AS op FROM sums", _SUMS))(
    lambda df: rules.run_rules(_with_total(df), YEAR, ["DQ-15"])
)


def _with_tiv(df: DataFrame) -> DataFrame:
    parts = sum(F.coalesce(F.col(f"c_{c}.value"), F.lit(0.0)) for c in O.AMOUNTS)
    off = F.when((F.col("sheet_row") - 2) % 10 == 0, 1.25).otherwise(1.0)
    return FR.with_clean(df).withColumn("tiv", F.floor(parts * off).cast("long").cast("string"))


_PARTS = " + ".join(f"coalesce(v_{c}, 0)" for c in O.AMOUNTS)
on_frame(
    "dq16",
    O.with_("SELECT 'DQ-16' AS rule, sheet_row, CAST(NULL AS VARCHAR) AS field, 'Medium' AS severity, CAST(tiv AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after, CAST(NULL AS VARCHAR) AS op FROM t WHERE tiv <> 0 AND parts <> 0 AND abs(parts - tiv) > abs(tiv) * 0.01", f"t AS (SELECT sheet_row, {_PARTS} AS parts, CAST(floor(({_PARTS}) * CASE WHEN (sheet_row - 2) % 10 = 0 THEN 1.25 ELSE 1.0 END) AS BIGINT) AS tiv FROM c)"),
)(lambda df: rules.run_rules(_with_tiv(df), YEAR, ["DQ-16"]))



def _total_unmapped(df: DataFrame) -> DataFrame:
    """The stated total is one of the columns that no target took; the rules must find it by its header and its numbers."""
    stated = _with_tiv(df)
    return rules.with_total(stated.withColumn("unmapped", F.create_map(F.lit("Notes"), F.lit("12"), F.lit("TIV (formula)"), F.lit(None).cast("string"), F.lit(" Total Insured Value "), F.col("tiv"), F.lit("Grand Total"), F.lit("1"))).drop("tiv"))


on_frame("total_column", _sql["dq16"])(lambda df: rules.run_rules(_total_unmapped(df), YEAR, ["DQ-16"]))

_COLS = "rule, sheet_row, field, severity, before, after, op"
on_frame("findings_union", O.on_findings(f"SELECT {_COLS} FROM f"))(lambda df: rules.run_rules(df, YEAR))
_RECONCILED = O.on_findings(f"SELECT {_COLS}, coalesce((SELECT array_to_string(list_sort(list(DISTINCT g.rule)), ',') FROM f g WHERE k.rule = 'DQ-12' AND g.rule IN ('DQ-05', 'DQ-06') AND g.field = k.field AND g.sheet_row = k.sheet_row), '') AS also_flagged FROM k")
on_frame("reconcile", _RECONCILED)(lambda df: findings_of(df).withColumn("also_flagged", F.array_join("also_flagged", ",")))
on_frame("reconcile_union", _RECONCILED)(lambda df: review.reconcile(rules.run_rules(df, YEAR)).withColumn("also_flagged", F.array_join("also_flagged", ",")))
on_frame("issue_groups", O.on_findings("SELECT rule, field, severity, count(DISTINCT sheet_row) AS n_rows, min(sheet_row) AS first_row, max(sheet_row) AS last_row FROM k GROUP BY ALL"))(lambda df: review.issues(findings_of(df)))
on_frame("issue_rows", O.on_findings("SELECT DISTINCT rule, field, severity, sheet_row FROM k"))(lambda df: review.issue_rows(findings_of(df)))
on_frame("counts_grouping_sets", O.on_findings(f"SELECT 'severity' AS kind, severity AS name, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'rule', rule, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'action_type', {O.ACTION}, count(*) FROM k GROUP BY ALL"))(
    lambda df: review.counts(findings_of(df))
)
_complete = "m AS (" + " UNION ALL ".join(
    f"SELECT {O.quoted(f)} AS field, {'true' if S.COLUMN_OF[f] in O.COLS else 'false'} AS mapped, count(*) AS n_rows, "
    + (f"count(*) FILTER (WHERE {'s_' + S.COLUMN_OF[f] + chr(32) + '<>' + chr(32) + chr(39) + 'empty' + chr(39) if S.COLUMN_OF[f] in O.AMOUNTS + O.INTEGERS else 'NOT ' + O.null(S.COLUMN_OF[f])})" if S.COLUMN_OF[f] in O.COLS else "CAST(0 AS BIGINT)")
    + f" AS non_null, CAST({S.WEIGHTS[f]} AS DOUBLE) AS weight FROM c"
    for f in S.FIELD_NAMES
) + "), cm AS (SELECT *, round(non_null / n_rows, 4) AS completeness FROM m)"
on_frame("completeness", O.with_("SELECT * FROM cm", _complete))(lambda df: score.completeness(df))
_COST = "(CASE severity WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.4 ELSE 0.1 END) * coalesce(CASE field " + " ".join(f"WHEN {O.quoted(k)} THEN {v}" for k, v in S.WEIGHTS.items()) + " END, 1.0)"
_SCORE = f"""SELECT *, round(least(1.0, greatest(0.0, 0.6 * completeness + 0.25 * validity + 0.15 * coverage)), 4) AS score FROM (
 SELECT round(sum(completeness * weight) / sum(weight), 4) AS completeness, round(greatest(0.0, 1 - (SELECT CAST(sum({_COST}) AS DOUBLE) FROM k WHERE rule <> 'DQ-01') / (max(n_rows) * sum(weight))), 4) AS validity, round(sum(CASE WHEN mapped THEN weight ELSE 0 END) / sum(weight), 4) AS coverage FROM cm)"""
on_frame("quality_score", O.on_findings(_SCORE, _complete))(lambda df: score.quality_score(score.completeness(df), findings_of(df)))
on_frame("value_gaps", O.with_(f"SELECT field FROM cm WHERE mapped AND completeness = 0 AND field IN {O.among(S.VALUE_FIELDS)} UNION ALL SELECT 'Other' FROM cm WHERE field = 'Other' AND n_rows > 0", _complete))(
    lambda df: score.value_gaps(score.completeness(df.withColumn("other", F.when(F.col("zip") == "none such", "1"))))
)
_REC = "rec_id, position, rule, field, op, action_type, severity, n_findings, n_rows, first_row, last_row, confidence, uncertain"


def recommended(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, recommendations), written, as later steps read them more than once."""
    found = written(findings_of(df), "findings")
    return found, written(review.recommendations(found), "recommendations")


on_frame("recommendations", O.on_findings(f"SELECT {_REC} FROM r", O.RECS))(lambda df: review.recommendations(findings_of(df)))
on_frame("review_queue", O.on_findings("SELECT position, rec_id, severity, rule FROM r WHERE severity = 'High'", O.RECS))(lambda df: review.recommendations(findings_of(df)).filter("severity = 'High'").select("position", "rec_id", "severity", "rule"))
on_frame("examples_top20", O.on_findings("""SELECT rule, field, op, sheet_row, before, after FROM (SELECT *, row_number() OVER (PARTITION BY rule, field, op ORDER BY CASE WHEN again = 1 THEN 0 ELSE 1 END, sheet_row, before) AS place FROM
 (SELECT *, row_number() OVER (PARTITION BY rule, field, op, before, after ORDER BY sheet_row) AS again FROM k WHERE op IS NOT NULL)) WHERE place <= 20"""))(lambda df: review.examples(findings_of(df)))
on_frame("recommendation_contract", O.on_findings("SELECT rec_id, CAST(NULL AS VARCHAR) AS problem FROM r WHERE n_rows < 1", O.RECS))(lambda df: review.invalid(*reversed(recommended(df))))

# a reviewer who accepts every operation but the mapping of sprinklers, which is rejected
_DECIDE = "CASE WHEN op = 'map_values' THEN 'rejected' WHEN op IS NULL THEN 'pending' ELSE 'approved' END"


def decided(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    found, recs = recommended(df)
    choice = F.when(F.col("op") == "map_values", "reject").otherwise("accept")
    decisions = recs.filter("op is not null").select("rec_id", choice.alias("decision"), F.lit(None).cast("string").alias("edited_op"), F.lit("reviewer").alias("reviewer"))
    return found, transform.apply_decisions(recs, decisions)


on_frame("apply_decisions", O.on_findings(f"SELECT rec_id, rule, field, op, {_DECIDE} AS status FROM r", O.RECS))(lambda df: decided(df)[1].select("rec_id", "rule", "field", "op", "status"))


def _transformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    found, recs = decided(df)
    return transform.transform(df, found, recs, {f: f"Column of {f}" for f in S.FIELD_NAMES}, "2026-01-01")


# every approved operation of the fixture yields its finding's own proposal; a cell with two keeps none if one is set_null
_CHANGED = "a AS (SELECT sheet_row, field, CASE WHEN bool_or(op = 'set_null') THEN NULL ELSE max(after) END AS after, min(before) AS before, string_agg(op, ',' ORDER BY CASE rule WHEN 'DQ-12' THEN 0 ELSE 1 END, rule) AS operation FROM k WHERE op IS NOT NULL AND op <> 'map_values' GROUP BY sheet_row, field)"
on_frame("audit_diff", O.on_findings("SELECT sheet_row, field, operation, before, coalesce(after, '(empty)') AS after, 'reviewer' AS approved_by, 'Column of ' || field AS source_column, '2026-01-01' AS changed_at FROM a", _CHANGED))(lambda df: _transformed(df)[1])
_CLEANED = "SELECT c.sheet_row, " + ", ".join((f"CASE WHEN a_{c}.sheet_row IS NOT NULL THEN a_{c}.after ELSE c.{c} END AS {c}" if c in ("zip", "state", "building_value", "contents", "bi", "storeys", "year_built") else f"c.{c}") if c in O.COLS else f"CAST(NULL AS VARCHAR) AS {c}" for c in S.COLUMNS) + " FROM c " + " ".join(f"LEFT JOIN a a_{c} ON a_{c}.sheet_row = c.sheet_row AND a_{c}.field = {O.quoted(S.FIELD_OF[c])}" for c in ("zip", "state", "building_value", "contents", "bi", "storeys", "year_built"))
on_frame("cleaned_sov", O.on_findings(_CLEANED, _CHANGED))(lambda df: _transformed(df)[0])


def _excluding(df: DataFrame) -> DataFrame:
    total = _with_total(df)
    found = rules.run_rules(total, YEAR, ["DQ-15"])
    recs = review.recommendations(found).select("*", F.lit("approved").alias("status"), F.col("op").alias("final_op"), F.lit("reviewer").alias("reviewer"))
    cleaned, audit = transform.transform(total, found, recs)
    return transform.run_metrics(total, cleaned, audit)


on_frame("exclude_rows", "SELECT count(*) + 1 AS rows_processed, count(*) AS rows_output, CAST(1 AS BIGINT) AS audit_entries, CAST(1 AS BIGINT) AS rows_excluded FROM customer")(_excluding)
_BAD = "SELECT sheet_row, 'Building Value is negative' AS problem FROM z WHERE TRY_CAST(building_value AS DOUBLE) < 0 UNION ALL SELECT sheet_row, 'Zip is not five digits' FROM z WHERE NOT " + O.null("zip") + " AND NOT regexp_matches(zip, '^[0-9]{5}$') UNION ALL SELECT sheet_row, 'State is not a code' FROM z WHERE NOT " + O.null("state") + f" AND state NOT IN {O.among(S.STATE_CODES)}"
on_frame("self_check", O.on_findings(_BAD, _CHANGED, f"z AS ({_CLEANED})"))(lambda df: transform.self_check(_transformed(df)[0]))
_STATUS = "(VALUES " + ", ".join(f"('{r.name}', {'false' if r.name == 'DQ-16' else 'true'}, {O.quoted('needs tiv') if r.name == 'DQ-16' else 'CAST(NULL AS VARCHAR)'})" for r in rules.REGISTRY) + ") x(rule, evaluated, reason)"
on_frame("rule_status", O.on_findings(f"SELECT x.*, (SELECT count(*) FROM f WHERE f.rule = x.rule) AS n_findings FROM {_STATUS}"))(lambda df: rules.rule_status(df, rules.run_rules(df, YEAR)))
on_frame("preview", O.with_(f"SELECT sheet_row, {', '.join(f'coalesce({c}, {chr(39) * 2}) AS {c}' for c in O.COLS)} FROM sov ORDER BY sheet_row LIMIT 100"))(
    lambda df: df.orderBy("sheet_row").limit(100).select("sheet_row", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in O.COLS])
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.recommendations(findings_of(frame(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from gridmend.plans import by_file, more_queries  # noqa: F401  register the rest

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from gridmend.plans import by_file, more_queries  # noqa: F401

    return dict(_sql)
