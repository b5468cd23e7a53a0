"""Queries on many files in one frame. Their SQL evaluates each file by itself, so they match only if no file changes another's results."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend import run
from gridmend import schema as S
from gridmend.operators import frame as FR
from gridmend.operators import model
from gridmend.operators import review, rules, score, transform
from gridmend.operators.frame import FILE
from gridmend.plans import oracle as O
from gridmend.plans import registry as R
from gridmend.plans.fixture import frame
from gridmend.scratch import dealt, scratch, written
from gridmend.sources import grid
from gridmend.streaming import files as arriving

#: The customers are dealt to so many files; the last one has no columns of storeys and zips.
FILES = 2
_LACKS = ["storeys", "zip"]
_OF_FILE = "FROM customer"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = (F.col("sheet_row") - 2) % FILES
    lacks = F.array_except(F.array(*map(F.lit, O.COLS)), F.array(*map(F.lit, _LACKS)))
    have = F.when(part == FILES - 1, lacks).otherwise(F.array(*map(F.lit, O.COLS)))
    return frame(spark, sf_dir).withColumns({FILE: F.concat(F.lit("file "), part.cast("string")), "fields": have})


def each_file(sql: str, columns: str, without: str = "") -> str:
    """The union of a query over each file alone. without: a condition that rows of the last file, which lacks some columns, must meet."""
    parts = []
    for k in range(FILES):
        own = sql.replace(_OF_FILE, f"FROM (SELECT * FROM customer WHERE c_custkey % {FILES} = {k})")
        if k == FILES - 1:
            for c in _LACKS:
                own = own.replace(f" END AS {c},", f" END AS {c}_not_there, CAST(NULL AS VARCHAR) AS {c},")
        where = f" WHERE {without}" if k == FILES - 1 and without else ""
        parts.append(f"SELECT 'file {k}' AS file_id, {columns} FROM ({own}){where}")
    return " UNION ALL ".join(parts)


_NOT_EMPTY = "NOT (rule = 'DQ-01' AND field IN ('Zip', 'Storeys'))"


def by_file(name: str, sql: str):
    return lambda f: R.query(name, sql)(lambda spark, d: f(files(spark, d)))


# a column that a file lacks reads as null in SQL; what it must not give is DQ-01, which the last file's common expressions leave out
def _alone(body: str, columns: str, *more: str) -> str:
    lost = O.ALL.replace("f AS (", "f AS (SELECT * FROM (").removesuffix(")") + ") WHERE /*keep*/ true)"
    text = O.with_(body, O.S17, lost, O.LOST, *more)
    parts = each_file(text, columns).split(" UNION ALL SELECT 'file ")
    parts[-1] = parts[-1].replace("/*keep*/ true", _NOT_EMPTY)
    return " UNION ALL SELECT 'file ".join(parts)


_COLS = "rule, sheet_row, field, severity, before, after, op"
by_file("findings_by_file", _alone(f"SELECT {_COLS} FROM f", _COLS))(lambda df: rules.run_rules(df, O.YEAR))



def _in_pieces(df: DataFrame) -> DataFrame:
    """The findings of files that a stream brings in three pieces, each row in one of them; marks are in the second."""
    spark = df.sparkSession
    folder, landing = scratch(spark, "judged"), scratch(spark, "landing")
    none = F.lit(None).cast("long")
    for k in range(3):
        piece = df.filter(F.col("sheet_row") % 3 == k).withColumn(arriving.MARK, none)
        if k == 1:
            piece = piece.unionByName(df.groupBy(FILE).agg(F.count("*").alias(arriving.MARK)), allowMissingColumns=True)
        piece.write.parquet(f"{landing}/{k}")
        stream = spark.readStream.schema(piece.schema).parquet(f"{landing}/*")
        arriving.judge_files(stream, O.YEAR, folder, f"{folder}-offsets", lambda whole: rules.run_rules(whole, O.YEAR))
    return arriving.judged(spark, folder)


by_file("findings_of_arriving_files", R._sql["findings_by_file"])(_in_pieces)


def _found(df: DataFrame) -> DataFrame:
    return written(rules.run_rules(df, O.YEAR, reconciled=True), "findings")


by_file("recommendations_by_file", _alone(f"SELECT {R._REC} FROM r", R._REC, O.RECS))(lambda df: review.recommendations(_found(df)))
_SCORED = "completeness, validity, coverage, score"


def _scores() -> str:
    """The score's SQL, with the last file's missing columns as not mapped."""
    parts = _alone(R._SCORE, _SCORED, R._complete).split(" UNION ALL SELECT 'file ")
    for c in _LACKS:
        f = O.quoted(S.FIELD_OF[c])
        parts[-1] = parts[-1].replace(f"SELECT {f} AS field, true AS mapped", f"SELECT {f} AS field, false AS mapped")
    return " UNION ALL SELECT 'file ".join(parts)


by_file("score_by_file", _scores())(lambda df: score.quality_score(score.completeness(df), _found(df)))
_AUDIT = "sheet_row, field, operation, before, after, approved_by"


def _cleaned(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = _found(df)
    recs = written(review.recommendations(found), "recommendations")
    choice = F.when(F.col("op") == "map_values", "reject").otherwise("accept")
    decisions = recs.filter("op is not null").select(FILE, "rec_id", choice.alias("decision"), F.lit(None).cast("string").alias("edited_op"), F.lit("reviewer").alias("reviewer"))
    return transform.transform(df, found, transform.apply_decisions(recs, decisions))


by_file("audit_by_file", _alone("SELECT sheet_row, field, operation, before, coalesce(after, '(empty)') AS after, 'reviewer' AS approved_by FROM a", _AUDIT, R._CHANGED))(lambda df: _cleaned(df)[1].select(FILE, *[F.col(c) for c in _AUDIT.split(", ")]))
_STATE = "rule, evaluated, reason, n_findings"


def _status_sql() -> str:
    needs = {r.name: [n for n in r.needs if n in _LACKS or n == "tiv"] for r in rules.REGISTRY}
    rows = lambda lacks: ", ".join(f"('{r}', {'false' if (miss := [n for n in ns if n in lacks]) else 'true'}, {O.quoted('needs ' + ', '.join(miss)) if miss else 'CAST(NULL AS VARCHAR)'})" for r, ns in needs.items())
    parts = _alone(f"SELECT x.*, (SELECT count(*) FROM f WHERE f.rule = x.rule) AS n_findings FROM (VALUES {rows(['tiv'])}) x(rule, evaluated, reason)", _STATE).split(" UNION ALL SELECT 'file ")
    parts[-1] = parts[-1].replace(rows(["tiv"]), rows(["tiv", *_LACKS]))
    return " UNION ALL SELECT 'file ".join(parts)


by_file("rule_status_by_file", _status_sql())(lambda df: rules.rule_status(df, written(rules.run_rules(df, O.YEAR), "findings")))

# a location that two rows or more share, each with a reference of its own, is likelier a campus
_KEYED = f"SELECT sheet_row, CASE WHEN NOT {O.null('reference')} THEN {O.strip('reference')} END AS ref, CASE WHEN {O.null('address')} THEN '' ELSE {O.ADDRESS.replace('{0}', 'address')} END AS address_key, CASE WHEN {O.null('zip')} THEN '' ELSE substr(regexp_replace(zip, '[^0-9]', '', 'g'), 1, 5) END AS zip_key FROM c"
_CAMPUS = f"campus AS (SELECT sheet_row FROM ({_KEYED}) JOIN (SELECT address_key, zip_key FROM ({_KEYED}) WHERE address_key <> '' GROUP BY ALL HAVING count(*) > 1 AND count(ref) = count(*) AND count(DISTINCT ref) = count(*)) USING (address_key, zip_key))"
_SURE = f"CASE WHEN rule = 'DQ-13' AND first_row IN (SELECT sheet_row FROM campus) THEN least(confidence, {S.CAMPUS_CONFIDENCE}) ELSE confidence END"
R.on_frame("campus_recommendations", O.on_findings(f"SELECT rec_id, rule, field, op, first_row, CAST({_SURE} AS DOUBLE) AS confidence, {_SURE} < 0.7 AS uncertain FROM r", O.RECS, _CAMPUS))(
    lambda df: review.recommendations(_found(df), rules.campus_rows(df)).select("rec_id", "rule", "field", "op", "first_row", "confidence", "uncertain")
)

R.on_frame("eligible_for_reasoning", O.on_findings(f"SELECT {R._REC} FROM r WHERE uncertain QUALIFY row_number() OVER (ORDER BY position) <= 6", O.RECS))(lambda df: model.eligible(review.recommendations(_found(df))))


def _mapped(df: DataFrame) -> DataFrame:
    """The audit if every operation is accepted, the mapping of sprinklers, too, whose every row has its own proposal."""
    found = _found(df)
    recs = written(review.recommendations(found), "recommendations")
    decisions = recs.select("rec_id", F.lit("accept").alias("decision"), F.lit(None).cast("string").alias("edited_op"), F.lit("reviewer").alias("reviewer"))
    return transform.transform(df, found, transform.apply_decisions(recs, decisions))[1].filter("field like '%prinkler%'").select(*_AUDIT.split(", "))


_SPRINKLED = R._CHANGED.replace(" AND op <> 'map_values'", "")
R.on_frame("audit_map_values", O.on_findings("SELECT sheet_row, field, operation, before, coalesce(after, '(empty)') AS after, 'reviewer' AS approved_by FROM a WHERE field LIKE '%prinkler%'", _SPRINKLED))(_mapped)


@R.query("preview_total", "SELECT count(*) AS n_rows FROM customer")
def preview_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a preview of the first rows is a part of."""
    return frame(spark, sf_dir).agg(F.count("*").alias("n_rows"))


# workbooks of typed cells: numbers with exponents, dates in a column of years, booleans
ROWS = 500


def typed_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): XLSX files of ROWS customers each, which tasks write."""

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [["Loc #", "Street Address", "Bldg Value", "Contents", "Yr Built", "Stories", "Sprinklers"]]
        for k in sorted(pdf["c_custkey"]):
            k, year = int(k), 1950 + int(k) % 60
            built = [year, pd.Timestamp(year, 1 + k % 12, 1).to_pydatetime(), f"{year}-01-01", k % 2 == 0][k % 4]
            rows.append([f"L{k}", f"{k} Main Street", [Decimal(f"{1 + k % 9}.25E+{6 + k % 3}"), 100000 + k, f"${k},000.00"][k % 3], [k + 0.5, pd.Timestamp(2020, 1, 1).to_pydatetime(), True][k % 3], built, [1 + k % 4, 1.5][k % 7 == 0], ["Y", True, "N"][k % 3]])
        return pd.DataFrame({"path": [f"mem:/book-{int(pdf['part'].iloc[0])}.xlsx"], "content": [grid.write_xlsx(rows)]})

    keyed = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.floor(F.col("c_custkey") / ROWS).alias("part"))
    return dealt(keyed, "part").groupBy("part").applyInPandas(book, "path string, content binary")


_PLACED = f"p AS (SELECT c_custkey AS k, 1950 + c_custkey % 60 AS y, 'mem:/book-' || (c_custkey // {ROWS}) || '.xlsx' AS file_id, CAST(1 + row_number() OVER (PARTITION BY c_custkey // {ROWS} ORDER BY c_custkey) AS BIGINT) AS sheet_row FROM customer)"
_TYPED = f"""WITH {_PLACED} SELECT file_id, sheet_row,
 CAST(CASE k % 3 WHEN 0 THEN (1.25 + k % 9) * (10 ** (6 + k % 3)) WHEN 1 THEN 100000 + k ELSE k * 1000 END AS DOUBLE) AS building_value, CASE k % 3 WHEN 2 THEN 'reformatted' ELSE 'ok' END AS building_status,
 CASE k % 3 WHEN 0 THEN k + 0.5::DOUBLE END AS contents, CASE k % 3 WHEN 0 THEN 'ok' ELSE 'unparseable' END AS contents_status,
 CASE WHEN k % 4 < 2 THEN CAST(y AS DOUBLE) END AS year_built, CASE k % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'reformatted' ELSE 'unparseable' END AS year_status,
 CAST(CASE WHEN k % 7 = 0 THEN 1.5 ELSE 1 + k % 4 END AS DOUBLE) AS storeys, CASE WHEN k % 7 = 0 THEN 'fractional' ELSE 'ok' END AS storeys_status, CASE k % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'True' ELSE 'N' END AS sprinklers FROM p"""


@R.query("typed_cells", _TYPED)
def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of workbooks whose headers and sheets a run has to find for itself, all workbooks at once."""
    r = run.take(run.Run(O.YEAR, "typed"), grid.parse_workbooks(typed_workbooks(spark, sf_dir), None))
    read = FR.with_clean(written(run.schedule(run.map_columns(run.find_sheets(r))), "schedule"))
    names = {"building_value": "building", "contents": "contents", "year_built": "year", "storeys": "storeys"}
    return read.select(FILE, "sheet_row", *[x for c, n in names.items() for x in (F.col(f"c_{c}.value").alias(c), F.col(f"c_{c}.status").alias(f"{n}_status"))], "sprinklers")
