"""A workbook from its file to the cleaned schedule, and the header blocks and contracts on the way."""

import pytest
from pyspark.sql import functions as F

from gridmend import run
from gridmend.operators import mapping, rules, sheets
from gridmend.sources import grid

HEADER = ["Loc #", "Street Address", "City", "St", "Zip", "Bldg Value", "Contents", "Stories", "Yr Built", "Total Insured Value", "Sprinklers"]
BODY = [[f"L{k}", f"{100 + k} Main Street", "Boston", "ma" if k == 1 else "MA", "2110" if k == 2 else "02110", "$2,100,000.00" if k == 3 else str(500000 + 1000 * k), str(20000 + k), "3", "0" if k == 4 else str(1950 + k), str((2100000 if k == 3 else 500000 + 1000 * k) + 20000 + k + (90000 if k == 5 else 0)), "Yes" if k == 6 else "N"] for k in range(12)]


def workbook(tmp_path, rows, name="s.xlsx"):
    (tmp_path / name).write_bytes(grid.write_xlsx(rows))
    return f"file://{tmp_path}/{name}"


def test_run_of_a_workbook(spark, tmp_path):
    path = workbook(tmp_path, [["Schedule of values"], [], HEADER, *BODY])
    out = f"file://{tmp_path}/out"
    r = run.run_workbook(spark, path, 2026, "one", out, at="2026-01-01T00:00:00")
    targets = {m["header"]: m["target"] for m in r.mappings.collect()}
    assert targets["St"] == "State" and targets["Bldg Value"] == "Building Value" and targets["Total Insured Value"] is None
    found = {(f["rule"], f["sheet_row"]) for f in r.findings.filter("rule != 'DQ-01'").collect()}
    assert found == {("DQ-09", 5), ("DQ-08", 6), ("DQ-10", 7), ("DQ-12", 8), ("DQ-16", 9), *{("DQ-11", 10)}}
    cleaned, audit = run.read_run(spark, out, "one")
    rows = {x["sheet_row"]: x for x in cleaned.collect()}
    assert (rows[5]["state"], rows[6]["zip"], rows[7]["building_value"], rows[8]["year_built"], rows[10]["sprinklers"]) == ("MA", "02110", "2100000", None, "Y") and len(rows) == 12
    log = {(a["sheet_row"], a["field"]): a for a in audit.collect()}
    assert set(log) == {(5, "State"), (6, "Zip"), (7, "Building Value"), (8, "Year Built"), (10, "Fire Sprinklers (Y/N)")}
    assert log[(5, "State")]["source_column"] == "St" and log[(5, "State")]["changed_at"] == "2026-01-01T00:00:00" and log[(5, "State")]["approved_by"] == "auto"
    assert [name for name, _ in r.trace] == ["sheets", "mapping", "quality", "transformation"]


def test_contracts(spark, tmp_path):
    r = run.until_review(spark, workbook(tmp_path, [HEADER, *BODY]), 2026, "two")
    with pytest.raises(run.ContractViolation, match="undecided"):
        run.clean(r)
    reject = r.recommendations.select("rec_id", F.lit("reject").alias("decision"), F.lit(None).cast("string").alias("edited_op"), F.lit("me").alias("reviewer"))
    assert run.clean(run.decide(r, reject)).audit.count() == 0
    with pytest.raises(run.ContractViolation, match="no sheet is Primary"):
        run.map_columns(run.Run(2026, "three"))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with pytest.raises(run.ContractViolation, match="error"):
        run.read(spark, f"file://{tmp_path}/bad.xlsx", 2026, "four")


def blocks(spark, rows, spans=()):
    cells = [("s", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row) if v]
    g = sheets.trim_grid(spark.createDataFrame(cells, "sheet string, row_idx int, col_idx int, value string"))
    matches = mapping.match_target(g.select("value"), mapping.glossary_rows())
    merged = spark.createDataFrame(list(spans), "sheet string, r0 int, c0 int, r1 int, c1 int") if spans else None
    found = sheets.header_blocks(g, sheets.header_candidates(g, matches), matches, merged)
    return found.first(), [x["name"] for x in sheets.header_names(g, found).orderBy("col_idx").collect()]


def test_two_line_headers(spark):
    body = [["L1", "1 Main St", "5", "6", "7"], ["L2", "2 Main St", "8", "9", "7"], ["L3", "3 Main St", "8", "9", "7"]]
    found, names = blocks(spark, [["Title"], ["Loc #", "Address", "Values", "Values", "Values"], ["", "", "Building", "Contents", ""], [], *body])
    assert (found["header_row"], found["composite"], found["data_start"]) == (1, True, 4)
    assert names == ["Loc #", "Address", "Values › Building", "Values › Contents", "Values"]
    found, names = blocks(spark, [["Loc #", "Address", "Q", "Q", ""], ["", "", "alpha", "beta", ""], *body], [("s", 0, 2, 0, 3)])
    assert (found["header_row"], found["composite"]) == (0, True) and names[4] == "Unnamed_5"
    found, names = blocks(spark, [["Loc #", "Address", "Q", "Q", "Q"], *body])
    assert not found["composite"] and found["data_start"] == 1 and names[2:] == ["Q", "Q (2)", "Q (3)"]


def test_total_column_needs_numbers_and_the_best_hint(spark):
    df = spark.createDataFrame([(2, {"Total": "5", "TIV note": "see file", "my TIV": "=SUM"}), (3, {"Total": "6", "Sum insured": "7"})], "sheet_row long, unmapped map<string,string>")
    assert rules.total_column(df) == "Total"
    assert rules.total_column(df.filter("false")) is None


def test_white_space_cells_do_not_count(spark):
    cells = spark.createDataFrame([("s", 0, 0, "a"), ("s", 6, 0, "\t "), ("s", 0, 3, " ")], "sheet string, row_idx int, col_idx int, value string")
    assert [(r["n_rows"], r["n_cols"]) for r in sheets.trim_grid(cells).collect()] == [(1, 1)]
