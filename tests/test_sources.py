"""Reading workbooks: delimiters, ragged rows, merged ranges, broken files; and the streaming rules."""

import zipfile

import pytest
from pyspark.sql import functions as F

from gridmend.operators import memory, sheets
from gridmend.plans import more_queries
from gridmend.sources import grid


def test_csv_and_xlsx_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Loc;City\n1;Bos ton\n2;\n".encode())
    (tmp_path / "b.xlsx").write_bytes(grid.write_xlsx([["Loc", "City"], ["1", None], ["<&>", "x"]]))
    (tmp_path / "c.xlsx").write_bytes(b"not a zip")
    (tmp_path / "d.csv").write_bytes(b"\n")
    rows = grid.read_workbooks(spark, f"file://{tmp_path}").collect()
    cells = {(r["path"][-5:], r["row_idx"], r["col_idx"]): r["value"] for r in rows if r["kind"] == "cell"}
    assert cells[("a.csv", 1, 1)] == "Bos ton" and cells[("a.csv", 2, 0)] == "2" and cells[("a.csv", 0, 0)] == "Loc"
    assert cells[(".xlsx", 2, 0)] == "<&>" and (".xlsx", 1, 1) not in cells
    assert sorted(r["path"][-6:] for r in rows if r["kind"] == "error") == ["/d.csv", "c.xlsx"]


def test_oversized_sheet_is_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" * 20)
    rows = grid.read_workbooks(spark, f"file://{tmp_path}", max_rows=10).collect()
    assert [r["kind"] for r in rows] == ["oversized"]
    whole = grid.read_workbooks(spark, f"file://{tmp_path}", max_rows=None)
    assert whole.filter("kind = 'cell'").count() == 40
    (tmp_path / "a.csv").write_text("x," + "y" * 200_000)
    assert [r["kind"] for r in grid.read_workbooks(spark, f"file://{tmp_path}").collect()] == ["error"]


def test_dates_and_booleans(tmp_path):
    path = tmp_path / "d.xlsx"
    path.write_bytes(grid.write_xlsx([["a"]]))
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{grid._NS["m"]}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.0&quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'.encode()
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{grid._NS["m"]}"><sheetData><row r="1"><c r="A1" s="1"><v>32874</v></c><c s="2"><v>32874.5</v></c><c s="3"><v>32874</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>'.encode()
    with zipfile.ZipFile(path, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    cells = [(r[3], r[4]) for r in grid.parse_xlsx(path.read_bytes())]
    assert cells == [(0, "1990-01-01"), (1, "1990-01-01 12:00:00"), (2, "32874"), (3, "True")]


def test_schedule_of_many_rows_is_read_whole(spark, small, monkeypatch):
    monkeypatch.setattr(grid, "MAX_ROWS", 10)
    monkeypatch.setattr(grid.read_workbooks, "__defaults__", (10,))
    found = {r["part"]: r["cells"] for r in more_queries.csv_cells(spark, small).collect()}
    customers = spark.read.parquet(f"{small}/customer.parquet").selectExpr("cast(c_custkey % 4 as int) part").groupBy("part").count().collect()
    assert found == {r["part"]: r["count"] * 5 for r in customers}
    read = grid.read_workbooks
    monkeypatch.setattr(grid, "read_workbooks", lambda spark, path, max_rows: read(spark, path, 5))
    with pytest.raises(Exception, match="oversized"):
        more_queries.csv_cells(spark, small).collect()


def test_merged_range_is_a_span(tmp_path):
    data = grid.write_xlsx([["Values", None], ["a", "b"]])
    path = tmp_path / "m.xlsx"
    path.write_bytes(data)
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(b"</worksheet>", b'<mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    with zipfile.ZipFile(path, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    spans = [r for r in grid.parse_xlsx(path.read_bytes()) if r[7] == "span"]
    assert spans == [(0, "Sheet1", 0, 0, None, 0, 1, "span", None)]


def test_headers_are_matched_in_all_rows_scanned(spark):
    """Texts that only the tenth row has are looked up: header_candidates scores it, too."""
    cells = [("s", r, c, f"x{r}{c}") for r in range(40) for c in range(3) if r != 9] + [("s", 9, c, h) for c, h in enumerate(["City", "Zip", "LOC-01234"])]
    grid_ = spark.createDataFrame(cells, "sheet string, row_idx int, col_idx int, value string")
    matches = more_queries._matches(spark, grid_)
    assert {r["value"]: r["target"] for r in matches.collect()} == {"City": "City", "Zip": "Zip", "LOC-01234": "Reference"}
    rows = {r["row_idx"]: r["vocabulary"] for r in sheets.header_candidates(sheets.trim_grid(grid_), matches).collect()}
    assert rows[9] == 1.0 and rows[8] == 0.0


def test_nearest_of_more_queries_than_one_block(spark, small, monkeypatch):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").repartition(3)
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    result = lambda df: sorted(tuple(r) for r in df.collect())
    want, scores = result(memory.nearest(queries, rows)), result(more_queries.semantic_matrix(spark, small))
    monkeypatch.setattr(memory, "MAX_QUERIES", 7)
    assert result(memory.nearest(queries, rows)) == want and len(want) == 5 * queries.count() > 5 * 7
    monkeypatch.setattr(memory, "MAX_QUERIES", 3)
    assert result(more_queries.semantic_matrix(spark, small)) == scores


def test_delimited_files_are_read_by_ranges(spark, tmp_path, monkeypatch):
    """Quoted fields of several lines over many splits, against the csv module on the whole text."""
    import csv
    import io
    import random

    r = random.Random(2)
    field = lambda: r.choice(["a", "", '"x;y"', '"two\nlines"', '"say ""hi"""', "it's", 'a 5" pipe', ' "late"', "é😀", '"\n\n"', "12.5"])
    for name, sep in (("one.csv", ";"), ("two b+c.csv", ","), ("Three.CSV", "\t")):
        text = "\ufeff" + "\r\n".join(sep.join(field().replace(";", sep) for _ in range(r.randint(1, 5))) if r.random() > 0.1 else "" for _ in range(400)) + "\n\n,,\n".replace(",", sep)
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for at_once in (200_000, 0):
        monkeypatch.setattr(grid.delimited, "SPLITS_AT_ONCE", at_once)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        try:
            assert grid.delimited.lines_of(spark, f"file://{tmp_path}").select("path", "block").distinct().count() > 15
            rows = grid.read_workbooks(spark, f"file://{tmp_path}", None).collect()
            sizes = {x["path"].rsplit("/", 1)[-1]: x["n_rows"] for x in grid.delimited.read_rows(spark, f"file://{tmp_path}")[1].collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        for name in ("one.csv", "two b+c.csv", "Three.CSV"):
            text = (tmp_path / name).read_bytes().decode("utf-8-sig")
            found = csv.Sniffer().sniff(text[: 64 << 10], ",;\t|")
            want = {(i, j): " ".join(v.split()) or None for i, row in enumerate(csv.reader(io.StringIO(text), found)) for j, v in enumerate(row)}
            got = {(x["row_idx"], x["col_idx"]): " ".join((x["value"] or "").split()) or None for x in rows if x["path"].endswith("/" + name) and x["kind"] == "cell"}
            assert got == want, name
            assert sizes[name] == 1 + max(i for (i, _), v in want.items() if v)


def test_odd_files_are_errors(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n,,\n")
    (tmp_path / "old.xls").write_text("x")
    (tmp_path / "long.csv").write_text("x,y\nz," + "y" * 200_000 + "\n")
    rows = grid.read_workbooks(spark, f"file://{tmp_path}")
    said = {r["path"].rsplit("/", 1)[-1]: r["value"] for r in rows.filter("kind = 'error'").collect()}
    assert set(said) == {"none.csv", "blank.csv", "old.xls", "long.csv"} and "empty" in said["none.csv"] and "supported" in said["old.xls"]
    assert {r["path"].rsplit("/", 1)[-1] for r in grid.sound(rows).collect()} == {"a b.csv"}


def test_numbers_dates_and_epochs(tmp_path):
    path = tmp_path / "d.xlsx"
    path.write_bytes(grid.write_xlsx([["a"]]))
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/workbook.xml"] = parts["xl/workbook.xml"].replace(b"<sheets>", b'<workbookPr date1904="1"/><sheets>')
    cells = '<c r="A1" s="1"><v>32874</v></c><c><v>1.25E+7</v></c><c><v>-3.5e-3</v></c><c><v>2110</v></c><c><v>7.0</v></c><c t="d"><v>1990-01-03T00:00:00</v></c><c s="1"><v>9e99</v></c><c t="e"><v>#REF!</v></c><c><v>nan</v></c>'
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{grid._NS["m"]}"><sheetData><row r="1">{cells}</row></sheetData></worksheet>'.encode()
    with zipfile.ZipFile(path, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    found = [(r[4], r[8]) for r in grid.parse_xlsx(path.read_bytes())]
    assert found[:6] == [("1994-01-02", "date"), ("12500000", "number"), ("-0.0035", "number"), ("2110", "number"), ("7", "number"), ("1990-01-03", "date")]
    assert found[6][1] == "number" and "E" not in found[6][0].upper() and found[7:] == [("#REF!", "text"), ("nan", "text")]


def test_spans_end_with_the_grid(spark):
    cells = spark.createDataFrame([("s", 0, 0, "T", "text"), ("s", 2, 1, "5", "number")], "sheet string, row_idx int, col_idx int, value string, type string")
    spans = spark.createDataFrame([("s", 0, 0, 1_048_575, 16_383), ("s", 9, 9, 10, 10), ("other", 0, 0, 1, 1)], "sheet string, r0 int, c0 int, r1 int, c1 int")
    filled = {(r["row_idx"], r["col_idx"]): (r["value"], r["type"]) for r in sheets.merge_fill(cells, spans).collect()}
    assert filled == {(r, c): ("T", "text") for r in range(3) for c in range(2)}


def test_type_consistency_of_every_start(spark):
    """One pass over the cells gives what a pass for each start gives."""
    cells = [("s", r, c, "x" if (r * c) % 3 else str(r)) for r in range(70) for c in range(4) if (r + c) % 5]
    g = sheets.trim_grid(spark.createDataFrame(cells, "sheet string, row_idx int, col_idx int, value string"))
    starts = spark.createDataFrame([("s", k) for k in range(31)], "sheet string, start int")
    got = {r["start"]: r["type_consistency"] for r in sheets.type_consistency(g, starts).collect()}
    every = {r["start"]: r["type_consistency"] for r in sheets.type_consistency(g, starts, sample=10**9).collect()}
    assert got.keys() == every.keys() and all(abs(got[k] - every[k]) < 1e-12 for k in got) and len(got) == 31
