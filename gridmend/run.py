"""From workbooks to cleaned schedules and audits: all stages as one call, or up to the review and on from there.

A run takes a workbook or a folder of them. Every table has the file in column file_id, every stage is a fixed number of jobs whatever
the number of files, and what one file holds changes nothing in another's results. Tables are written before they are joined, so Spark knows from
their sizes whether to broadcast them. A stage's contract is checked by file: a file that
breaks it is left out of the stage and gets a row in `issues`; only when no file is left does the run stop.

With a folder `out` a run can be taken up by another session: its tables are written there by run, each stage ends with a row of state that says which
there are, and `resume` reads them. Writing the same run again replaces its tables.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmend import schema as S
from gridmend.operators import mapping, model, profile, review, rules, score, sheets, transform
from gridmend.operators.frame import FILE
from gridmend.scratch import written
from gridmend.sources import grid

#: Changes with the tables' meaning; `resume` refuses a run of another version.
STATE_VERSION = 2
TABLES = ["files", "cells", "spans", "sheet_names", "manifest", "columns", "mappings", "issues", "frame", "findings", "quality", "recommendations", "cleaned", "audit", "opinions", "reasons"]
ISSUES = "file_id string, sheet string, stage string, rule string, field string, severity string, detail string"


class ContractViolation(ValueError):
    """A stage was asked for before what it needs is there."""


@dataclass
class Run:
    """What the stages have found so far; each table is written once."""

    year: int
    run_id: str
    out: str | None = None
    path: str | None = None
    files: DataFrame | None = None
    cells: DataFrame | None = None
    spans: DataFrame | None = None
    sheet_names: DataFrame | None = None
    manifest: DataFrame | None = None
    columns: DataFrame | None = None
    mappings: DataFrame | None = None
    issues: DataFrame | None = None
    frame: DataFrame | None = None
    findings: DataFrame | None = None
    quality: DataFrame | None = None
    recommendations: DataFrame | None = None
    cleaned: DataFrame | None = None
    audit: DataFrame | None = None
    opinions: DataFrame | None = None
    reasons: DataFrame | None = None
    trace: list[tuple[str, int]] = field(default_factory=list)
    step: int = 0

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """df written as the run's table of that name, in `out` if the run has one."""
        made = grid.write_table(df, self.out, name, self.run_id) if self.out else written(df, name)
        setattr(self, name, made)
        return made

    def note(self, more: DataFrame) -> None:
        """Adds issues."""
        both = written(more if self.issues is None else self.issues.unionByName(more), "issues")
        self.issues = grid.write_table(both, self.out, "issues", self.run_id) if self.out else both


_PRESENT = [("n_sheets > 0", "the manifest is empty"), ("n_primary = 1", "no sheet is Primary, or more than one")]
_MAPPED = [("n_columns > 0", "there is no mapping"), ("n_targets > 0", "no column has a target")]
#: What each stage needs of a file, over a file's row of `facts`, and what is said where it isn't met.
PRECONDITIONS: dict[str, list[tuple[str, str]]] = {
    "sheets": [("file_id <> ''", "there is no path"), ("file_name <> ''", "the file has no name")],
    "mapping": _PRESENT,
    "quality": [*_PRESENT, *_MAPPED],
    "transformation": [*_PRESENT, *_MAPPED, ("assessed", "there is no assessment"), ("n_open = 0", "recommendations are undecided")],
}


def facts(r: Run) -> DataFrame:
    """(file_id, file_name) with what the stages have so far of each file: counts, 0 where a table isn't there."""
    out, missing = r.files.select(FILE, "file_name"), {}
    decided = r.recommendations is not None and "status" in r.recommendations.columns
    wanted = [
        (r.manifest, {"n_sheets": F.count("*"), "n_primary": F.count_if(F.col("class") == "Primary") if r.manifest is not None else None}),
        (r.mappings, {"n_columns": F.count("*"), "n_targets": F.count("target")}),
        (r.quality, {"n_assessed": F.count("*")}),
        (r.recommendations, {"n_open": F.count_if(F.col("status") == "pending") if decided else F.count("*")}),
    ]
    for table, counts in wanted:
        if table is None:
            missing |= dict.fromkeys(counts, 0)
        else:
            out = out.join(table.groupBy(FILE).agg(*[c.alias(n) for n, c in counts.items()]), FILE, "left").fillna(0, list(counts))
    return out.withColumns({n: F.lit(v) for n, v in missing.items()}).withColumn("assessed", F.col("n_assessed") > 0)


def _check(r: Run, name: str) -> None:
    """Leaves out the files that break the stage's contract, as issues; an error if none is left."""
    needs = PRECONDITIONS[name]
    if r.files is None:
        raise ContractViolation(f"{name}: " + "; ".join(text for _, text in needs))
    failed = F.array_compact(F.array(*[F.when(~F.expr(f"coalesce({test}, false)"), text) for test, text in needs]))
    checked = facts(r).select(FILE, failed.alias("failed"))
    seen = checked.agg(F.count_if(F.size("failed") > 0).alias("bad"), F.count("*").alias("n"), F.max(F.when(F.size("failed") > 0, F.col("failed"))).alias("failed")).first()
    if not seen["bad"]:
        return
    if seen["bad"] == seen["n"]:
        raise ContractViolation(f"{name}: " + "; ".join(seen["failed"]))
    bad = written(checked.filter(F.size("failed") > 0), "contract")
    r.note(_issues(bad.select(FILE, F.array_join("failed", "; ").alias("detail")), name, "contract", "High"))
    r.keep("files", written(r.files.join(bad.select(FILE), FILE, "left_anti"), "files"))


def _issues(rows: DataFrame, stage: str, rule, severity) -> DataFrame:
    """rows as issues of a stage; what they lack is null."""
    have = {"stage": F.lit(stage), "rule": F.lit(rule), "severity": F.lit(severity)} | {c: F.col(c) for c in rows.columns}
    return rows.select(*[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in ISSUES.split(", "))])


def _of_files(df: DataFrame, r: Run) -> DataFrame:
    return df.join(r.files.select(FILE), FILE, "left_semi")


def stage(name: str):
    """Checks a stage's contract before it runs, adds its milliseconds to the trace, and keeps the state."""

    def wrap(f):
        def run(r: Run, *args, **kwargs) -> Run:
            _check(r, name)
            began = time.perf_counter()
            f(r, *args, **kwargs)
            r.trace.append((name, int((time.perf_counter() - began) * 1000)))
            _save(r)
            return r

        return run

    return wrap


_STATE = "version int, run_id string, path string, year int, step int, trace string, tables string"


def _state_folder(out: str, run_id: str) -> str:
    return f"{out}/state/run_id={run_id}"


def _save(r: Run) -> None:
    """A row that names the run's tables with their schemas; the last one written counts."""
    if not r.out:
        return
    spark = r.cells.sparkSession
    r.step += 1
    tables = {n: df.schema.jsonValue() for n in TABLES if (df := getattr(r, n)) is not None}
    row = (STATE_VERSION, r.run_id, r.path, r.year, r.step, json.dumps(r.trace), json.dumps(tables))
    spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{_state_folder(r.out, r.run_id)}/step={r.step:03d}")


def resume(spark: SparkSession, out: str, run_id: str) -> Run:
    """A run as its last finished stage left it."""
    try:
        state = spark.read.schema(_STATE).parquet(f"{_state_folder(out, run_id)}/*").orderBy(F.desc("step")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ContractViolation(f"there is no run {run_id} in {out}") from e
        raise
    if state["version"] != STATE_VERSION:
        raise ContractViolation(f"the run is of version {state['version']}, this is {STATE_VERSION}")
    r = Run(state["year"], run_id, out, state["path"], trace=[tuple(x) for x in json.loads(state["trace"])], step=state["step"])
    for name, found in json.loads(state["tables"]).items():
        setattr(r, name, spark.read.schema(T.StructType.fromJson(found)).parquet(f"{out}/{name}/run_id={run_id}"))
    return r


def _forget(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, path: str, year: int, run_id: str, out: str | None = None, max_rows: int | None = grid.MAX_ROWS) -> Run:
    """The cells of a workbook or of all below a folder, with merged ranges filled. Files that can't be read and sheets of more than max_rows rows are issues."""
    r = Run(year, run_id, out, path)
    if out:
        _forget(spark, _state_folder(out, run_id))
    return take(r, grid.read_workbooks(spark, path, max_rows))


def take(r: Run, cells: DataFrame) -> Run:
    """A run's cells from those of a source (`grid.CELLS`)."""
    rows = written(cells.withColumnRenamed("path", FILE), "workbook")
    bad = rows.filter("kind in ('error', 'oversized')").select(FILE, "sheet", F.col("kind").alias("rule"), F.coalesce("value", F.concat("row_idx", F.lit(" rows"))).alias("detail"))
    r.note(_issues(bad, "sheets", None, "High"))
    broken = written(rows.filter("kind = 'error'").select(FILE).distinct(), "broken")
    whole = rows.join(broken, FILE, "left_anti")
    keyed = whole.withColumn("sheet_name", F.col("sheet")).withColumn("sheet", F.concat_ws("#", FILE, "sheet_idx"))
    cells = keyed.filter("kind = 'cell'").select("sheet", "row_idx", "col_idx", "value", "type")
    r.keep("sheet_names", keyed.filter("kind = 'cell'").select("sheet", FILE, "sheet_name").distinct())
    if r.sheet_names.isEmpty():
        first = r.issues.first()
        raise ContractViolation(f"sheets: {first['rule']} {first['detail']}" if first else f"sheets: there are no cells in {r.path}")
    r.keep("files", r.sheet_names.select(FILE, F.regexp_extract(FILE, "([^/]*)$", 1).alias("file_name")).distinct())
    spans = r.keep("spans", keyed.filter("kind = 'span'").select("sheet", F.col("row_idx").alias("r0"), F.col("col_idx").alias("c0"), "r1", "c1"))
    r.keep("cells", sheets.trim_grid(cells if spans.isEmpty() else sheets.merge_fill(cells, spans)))
    return r


@stage("sheets")
def find_sheets(r: Run) -> None:
    """The manifest: each sheet's header block, scores and class, one Primary a file; and the names of the Primary sheets' columns."""
    spark = r.cells.sparkSession
    matches = written(mapping.match_target(r.cells.filter(F.col("row_idx") <= sheets.SCAN).select("value"), mapping.glossary_rows()), "matches")
    candidates = written(sheets.header_candidates(r.cells, matches), "candidates")
    blocks = written(sheets.header_blocks(r.cells, candidates, matches, r.spans), "blocks")
    scores = sheets.sheet_scores(r.cells, blocks.select("sheet", "header_row", "score"), matches).join(r.sheet_names, "sheet", "left")
    r.keep("manifest", sheets.classify_sheets(scores, FILE).join(blocks.drop("score"), "sheet", "left"))
    names = sheets.header_names(r.cells, blocks.join(_primary(r), "sheet", "left_semi")).join(_primary(r), "sheet")
    r.keep("columns", names.select(FILE, "sheet", F.col("col_idx").alias("column_idx"), F.col("name").alias("header")))


def _primary(r: Run) -> DataFrame:
    """(sheet, file_id, start): the sheet of each file that is read, and the row at which its data start."""
    return r.manifest.filter("class = 'Primary'").select("sheet", FILE, F.coalesce("data_start", F.lit(0)).alias("start"))


def _body(r: Run) -> DataFrame:
    return r.cells.join(_of_files(_primary(r), r), "sheet").filter(F.col("row_idx") >= F.col("start"))


@stage("mapping")
def map_columns(r: Run, extra: dict[str, list[str]] | None = None) -> None:
    cells = _body(r).select("sheet", F.col("col_idx").alias("column_idx"), F.col("row_idx").alias("pos"), "value", "type")
    phrases = mapping.glossary_rows(extra if extra is not None else mapping.MORE_PHRASES)
    columns = _of_files(r.columns, r)
    evidence = written(mapping.build_evidence(columns.drop(FILE), cells, phrases, r.year), "evidence")
    r.keep("mappings", mapping.map_columns(evidence).join(_primary(r).select("sheet", FILE), "sheet"))
    said = mapping.mapping_issues(r.mappings, columns).join(r.sheet_names, "sheet", "left")
    said = said.select(FILE, F.col("sheet_name").alias("sheet"), F.lit("mapping").alias("stage"), "rule", "field", "severity", F.lit(None).cast("string").alias("detail"))
    r.note(said)


def schedule(r: Run) -> DataFrame:
    """The frame of the Primary sheets: target columns, which of them a file has, kinds of cells, what no target took by header, and rows numbered as in the sheet."""
    taken = r.mappings.select("sheet", F.col("column_idx").alias("col_idx"), "header", "target")
    named = _body(r).join(taken, ["sheet", "col_idx"])
    own = [F.max(F.when(F.col("target") == f, F.col("value"))).alias(S.COLUMN_OF[f]) for f in S.FIELD_NAMES]
    column = F.create_map(*[F.lit(x) for f in S.FIELD_NAMES for x in (f, S.COLUMN_OF[f])])
    rest = F.map_from_entries(F.collect_list(F.when(F.col("target").isNull(), F.struct("header", "value")))).alias("unmapped")
    kinds = F.map_from_entries(F.collect_list(F.when(F.col("target").isNotNull() & (F.col("type") != "text"), F.struct(column[F.col("target")].alias("column"), "type")))).alias("kinds")
    rows = named.groupBy(FILE, (F.col("row_idx") + 1).cast("long").alias("sheet_row")).agg(*own, rest, kinds)
    fields = r.mappings.filter("target is not null").groupBy(FILE).agg(F.collect_set(column[F.col("target")]).alias("fields"))
    return rows.join(written(fields, "fields"), FILE)


@stage("quality")
def assess(r: Run) -> None:
    """Findings, the score and the review queue of the Primary sheets."""
    r.keep("frame", rules.with_total(written(schedule(r), "schedule")))
    readings = rules.with_readings(r.frame)
    r.keep("findings", rules.run_rules(readings, r.year, reconciled=True))
    r.keep("quality", score.quality_score(score.completeness(readings), r.findings))
    r.keep("recommendations", review.recommendations(r.findings, rules.campus_rows(r.frame)))


def adjudicate(r: Run, ask: model.Model | None, extra: dict[str, list[str]] | None = None, **how) -> Run:
    """After the mapping: columns whose runner-up is close, as a model's verified reply would have them. `opinions` has every call."""
    if ask is None:
        return r
    cells = _body(r).select("sheet", F.col("col_idx").alias("column_idx"), F.col("row_idx").alias("pos"), "value")
    profiled = written(profile.profile(cells.select(model.column_key().alias("column"), "pos", "value"), r.year), "profiles")
    phrases = mapping.glossary(r.cells.sparkSession, extra if extra is not None else mapping.MORE_PHRASES)
    made, opinions = model.adjudicate(r.mappings, cells, profiled, phrases, ask, **how)
    r.keep("opinions", opinions)
    r.keep("mappings", written(made.select(*r.mappings.columns), "adjudicated"))
    _save(r)
    return r


def reason(r: Run, ask: model.Model | None, **how) -> Run:
    """After the assessment: prose and doubt of the unsure recommendations, as far as a model's reply holds. `reasons` has every call."""
    if ask is None:
        return r
    made, reasons = model.reason(r.recommendations, r.findings, ask, **how)
    r.keep("reasons", reasons)
    r.keep("recommendations", written(made, "explained"))
    _save(r)
    return r


def decide(r: Run, decisions: DataFrame | None = None, reviewer: str = "auto") -> Run:
    """Applies a reviewer's decisions (file_id, rec_id, decision, edited_op, reviewer); without any, all recommendations are accepted.

    A run of one file may leave out file_id. Recommendations that no decision names keep the status that they have.
    """
    recs = r.recommendations
    if decisions is None:
        decisions = recs.select(FILE, "rec_id", F.lit("accept").alias("decision"), F.lit(None).cast("string").alias("edited_op"), F.lit(reviewer).alias("reviewer"))
    elif FILE not in decisions.columns:
        files = [x[FILE] for x in r.files.limit(2).collect()]
        if len(files) != 1:
            raise ContractViolation("decisions on several files need a file_id")
        decisions = decisions.withColumn(FILE, F.lit(files[0]))
    made = transform.apply_decisions(recs, written(decisions, "decisions"))
    r.keep("recommendations", written(made, "decided"))
    _save(r)
    return r


@stage("transformation")
def clean(r: Run, at: str | None = None) -> None:
    sources = r.mappings.filter("target is not null").groupBy(FILE).agg(F.map_from_entries(F.collect_list(F.struct("target", "header"))).alias("sources"))  # seventeen a file at most
    cleaned, audit = transform.transform(_of_files(r.frame, r), _of_files(r.findings, r), _of_files(r.recommendations, r), written(sources, "sources"), at)
    r.keep("cleaned", cleaned)
    r.keep("audit", audit)


def until_review(spark: SparkSession, path: str, year: int, run_id: str, out: str | None = None, max_rows: int | None = grid.MAX_ROWS) -> Run:
    """Everything that comes before a person's decisions."""
    return assess(map_columns(find_sheets(read(spark, path, year, run_id, out, max_rows))))


def run_workbook(spark: SparkSession, path: str, year: int, run_id: str, out: str | None = None, decisions: DataFrame | None = None, at: str | None = None, max_rows: int | None = grid.MAX_ROWS) -> Run:
    """All stages, of a workbook or a folder; without decisions every recommendation is accepted. out: a folder for the run's tables, by run_id."""
    return clean(decide(until_review(spark, path, year, run_id, out, max_rows), decisions), at)


def read_run(spark: SparkSession, out: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(cleaned, audit) of an earlier run."""
    return tuple(spark.read.parquet(f"{out}/{name}/run_id={run_id}") for name in ("cleaned", "audit"))
