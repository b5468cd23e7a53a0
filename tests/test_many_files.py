"""A folder of workbooks as one run: files don't change each other's results, jobs don't grow with files, a run is taken up by another session."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridmend import run
from gridmend import schema as S
from gridmend.functions import clean as C
from gridmend.operators import frame as FR
from gridmend.operators import rules, score, transform
from gridmend.plans.fixture import frame
from gridmend.sources import grid

HEADER = ["Loc #", "Street Address", "City", "St", "Zip", "Bldg Value", "Contents", "Stories", "Yr Built", "Sprinklers"]


def body(seed, n=12):
    return [[f"L{k}", f"{100 + seed * k} Main Street", "Boston", "ma" if (k + seed) % 5 == 0 else "MA", "02110", str(500_000 + 1000 * k * seed), str(20_000 + k), 3, 1900 if (seed == 1 and k < 4) or (seed == 2 and k < 2) else 1950 + k, "Yes" if k == seed else "Y"] for k in range(n)]


def folder(tmp_path, books):
    for name, rows in books.items():
        data = grid.write_xlsx(rows) if name.endswith("xlsx") else "\n".join(",".join("" if v is None else str(v) for v in row) for row in rows).encode()
        (tmp_path / name).write_bytes(data)
    return f"file://{tmp_path}"


BOOKS = {"a.xlsx": [HEADER, *body(1)], "b.xlsx": [["Title"], [], HEADER[:-3], *[r[:-3] for r in body(2)]], "c.csv": [HEADER, *body(3)]}


def rows_of(df, file_id=None):
    columns = sorted(c for c in df.columns if c not in ("file_id", "fields", "kinds", "unmapped"))
    rows = df.filter(F.col("file_id").endswith(file_id)) if file_id else df
    return sorted([tuple(r[c] for c in columns) for r in rows.collect()], key=repr)


def test_files_give_what_each_gives_alone(spark, tmp_path):
    (tmp_path / "all").mkdir()
    path = folder(tmp_path / "all", BOOKS | {"broken.xlsx": []})
    (tmp_path / "all" / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "all" / "notes.txt").write_text("x")
    (tmp_path / "all" / "empty.csv").write_text("")
    out = f"file://{tmp_path}/out"
    whole = run.until_review(spark, path, 2026, "all", out)
    told = {(x["file_id"][-9:], x["rule"]) for x in whole.issues.filter("stage = 'sheets'").collect()}
    assert told == {("ken.xlsx", "error")} or told == {("roken.xlsx"[-9:], "error"), ("notes.txt", "error"), ("empty.csv", "error")}
    assert whole.files.count() == 3 and whole.findings.filter("rule = 'DQ-12'").select("file_id").distinct().count() == 1
    for name in BOOKS:
        alone = run.until_review(spark, f"{path}/{name}", 2026, name)
        for table in ("mappings", "findings", "quality", "recommendations", "frame"):
            assert rows_of(getattr(whole, table), name) == rows_of(getattr(alone, table)), (name, table)
    # another session takes it up; one file's recommendations stay open, and only that file waits
    again = run.resume(spark.newSession(), out, "all")
    assert [name for name, _ in again.trace] == ["sheets", "mapping", "quality"] and again.year == 2026
    answers = again.recommendations.filter(~F.col("file_id").endswith("b.xlsx")).select("file_id", "rec_id", F.lit("accept").alias("decision"), F.lit(None).cast("string").alias("edited_op"), F.lit("me").alias("reviewer"))
    done = run.clean(run.decide(again, answers))
    assert {x["file_id"][-5:] for x in done.cleaned.select("file_id").distinct().collect()} == {".xlsx", "c.csv"}
    assert done.issues.filter("stage = 'transformation' and detail like '%undecided%'").count() == 1
    audit = rows_of(done.audit)
    assert audit and run.resume(spark, out, "all").audit.count() == len(audit)
    # the same once more changes nothing
    grid.write_tables(done.cleaned, done.audit, f"file://{tmp_path}/twice", "all")
    grid.write_tables(done.cleaned, done.audit, f"file://{tmp_path}/twice", "all")
    cleaned, log = run.read_run(spark, f"file://{tmp_path}/twice", "all")
    assert rows_of(log) == audit and cleaned.count() == 24
    grid.write_tables(done.cleaned, done.audit.limit(0), f"file://{tmp_path}/twice", "all")
    assert run.read_run(spark, f"file://{tmp_path}/twice", "all")[1].count() == 0
    with pytest.raises(run.ContractViolation, match="no run"):
        run.resume(spark, out, "none such")
    with pytest.raises(run.ContractViolation, match="need a file_id"):
        run.decide(run.resume(spark, out, "all"), answers.drop("file_id"))


def test_a_run_of_another_version_is_refused(spark, tmp_path, monkeypatch):
    r = run.find_sheets(run.read(spark, folder(tmp_path, {"a.xlsx": BOOKS["a.xlsx"]}), 2026, "v", f"file://{tmp_path}/out"))
    assert run.resume(spark, r.out, "v").manifest.count() == 1
    monkeypatch.setattr(run, "STATE_VERSION", 99)
    with pytest.raises(run.ContractViolation, match="version"):
        run.resume(spark, r.out, "v")


def jobs_of(spark, tag, f):
    spark.sparkContext.setJobGroup(tag, tag)
    f()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    spark.sparkContext.setJobGroup("other", "other")
    return n


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    for n in (2, 40):
        (tmp_path / str(n)).mkdir()
        folder(tmp_path / str(n), {f"f{k}.xlsx": [HEADER, *body(k % 5 + 1)] for k in range(n)})
    few, many = (jobs_of(spark, f"files-{n}", lambda n=n: run.find_sheets(run.read(spark, f"file://{tmp_path}/{n}", 2026, f"jobs-{n}"))) for n in (2, 40))
    assert few and abs(many - few) <= 0.1 * few, (few, many)


def test_oversized_sheets_are_reported_and_the_rest_runs(spark, tmp_path):
    path = folder(tmp_path, {"a.xlsx": BOOKS["a.xlsx"], "big.csv": [HEADER, *body(1, 40)]})
    r = run.read(spark, path, 2026, "over", max_rows=30)
    assert [(x["rule"], x["detail"]) for x in r.issues.collect()] == [("oversized", "41 rows")] and r.files.count() == 1
    assert run.read(spark, path, 2026, "whole", max_rows=None).files.count() == 2
    with pytest.raises(run.ContractViolation, match="oversized"):
        run.read(spark, path, 2026, "none", max_rows=3)


def test_every_precondition(spark):
    names = [(s, text) for s, needs in run.PRECONDITIONS.items() for _, text in needs]
    assert len(names) == 14
    r = run.Run(2026, "x")
    rows = [("", ""), ("f1", "f1"), ("f2", "f2"), ("f3", "f3"), ("f4", "f4"), ("f5", "f5"), ("f6", "f6")]
    r.files = spark.createDataFrame(rows, "file_id string, file_name string")
    at = lambda files, ddl, *more: spark.createDataFrame([(f, *x) for f, *x in files], "file_id string, " + ddl)
    r.manifest = at([("f1", "Reject"), *[(f"f{k}", "Primary") for k in (2, 3, 4, 5, 6)]], "class string")
    r.mappings = at([("f3", None), ("f4", "City"), ("f5", "City"), ("f6", "City")], "target string")
    r.quality = at([("f5", 1.0), ("f6", 1.0)], "score double")
    r.recommendations = at([("f5", "pending"), ("f6", "escalated")], "status string")
    seen = {x["file_id"]: x for x in run.facts(r).collect()}
    breaks = {f: [t for t, _ in run.PRECONDITIONS["transformation"] if not run.facts(r).filter(F.col("file_id") == f).filter(t).count()] for f in seen}
    assert [len(breaks[f]) for f in ("", "f1", "f2", "f3", "f4", "f5", "f6")] == [5, 4, 3, 2, 1, 1, 0]
    assert breaks["f4"] == ["assessed"] and breaks["f5"] == ["n_open = 0"]
    r.issues = spark.createDataFrame([], run.ISSUES)
    run._check(r, "transformation")
    assert [x["file_id"] for x in r.files.collect()] == ["f6"] and r.issues.count() == 6


def test_union_of_frames_with_other_columns(spark, small):
    """A file without some columns gives what the frame without them gives, in one frame with another file."""
    df = frame(spark, small)
    less = df.drop("zip", "storeys", "contents")
    both = df.withColumn("fields", F.array(*map(F.lit, FR.mapped(df)))).withColumn("file_id", F.lit("x")).unionByName(less.withColumn("fields", F.array(*map(F.lit, FR.mapped(less)))).withColumn("file_id", F.lit("y")), allowMissingColumns=True)
    found = rules.run_rules(both, 2026, reconciled=True)
    for name, alone in (("x", df), ("y", less)):
        own = rules.run_rules(alone, 2026, reconciled=True)
        assert rows_of(found, name) == rows_of(own)
        assert rows_of(score.quality_score(score.completeness(both), found), name) == rows_of(score.quality_score(score.completeness(alone), own))
        status = {x["rule"]: (x["evaluated"], x["n_findings"]) for x in rules.rule_status(both, found).filter(F.col("file_id") == name).collect()}
        assert status == {x["rule"]: (x["evaluated"], x["n_findings"]) for x in rules.rule_status(alone, own).collect()}


def test_typed_cells_read_as_what_they_are(spark, tmp_path):
    rows = [["Loc #", "Bldg Value", "Yr Built", "Contents", "Sprinklers"]] + [[f"L{k}", Decimal("1.25E+7"), datetime(1990, 1, 3), True, "Y"] for k in range(5)] + [["L9", "1.25E+7", "1990-01-03", 5.5, True]]
    r = run.map_columns(run.find_sheets(run.read(spark, folder(tmp_path, {"t.xlsx": rows}), 2026, "typed")))
    found = rules.run_rules(run.schedule(r), 2026, ["DQ-02", "DQ-03", "DQ-05", "DQ-17"]).collect()
    assert sorted((x["rule"], x["sheet_row"], x["field"]) for x in found) == sorted([("DQ-02", 7, "Building Value"), ("DQ-03", 7, "Year Built"), *[("DQ-02", k, "Contents") for k in range(2, 7)]])
    got = FR.typed(run.schedule(r)).filter("sheet_row = 2").first()
    assert (got["building_value"], got["year_built"]) == (12_500_000.0, 1990)
    cell = spark.createDataFrame([("1990-01-03", "1990")], "c string, after string")
    assert cell.select(transform.apply_op(F.lit("to_int"), F.col("c"), F.col("after"))).first()[0] == "1990"


def test_both_readings_of_amounts_agree(spark):
    cells = ["", " 12 ", "$1,000.50", "(45,000)", "--45", "-", "N/A", "1.5.2", "£ 3", "( )", "(-5)", "1e5", None, "€-7"]
    df = spark.createDataFrame([(c,) for c in cells], "bi string")
    read = FR.with_clean(df).select("bi", "c_bi.*", C.clean_amount(F.col("bi")).alias("x")).collect()
    assert all((r["value"], r["status"], r["removed"]) == tuple(r["x"]) for r in read) and len(read) == len(cells)
    assert len(S.FIELD_NAMES) == 17
