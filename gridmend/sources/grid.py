"""Workbooks as cells in long form: CSV and XLSX files, and writers for small results.

A CSV file is read by as many tasks as it has splits (`delimited`), an XLSX file by one, which pulls its sheets' cells out one
after the other and holds none of them: the file's bytes and its shared texts are all that it keeps.

A cell has a value as text and a type: text, number, date or boolean. A number's value is written without an exponent, a date's
as ISO, so readers of text read them alike; where a type matters (a date in a column of years) it is asked for by name.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from decimal import Decimal
from urllib.parse import unquote
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.scratch import join_small
from gridmend.sources import delimited

MAX_ROWS = 50_050
CELLS = "path string, sha256 string, sheet_idx int, sheet string, row_idx int, col_idx int, value string, r1 int, c1 int, kind string, type string"
NAMES = [x.split()[0] for x in CELLS.split(", ")]
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_M = f"{{{_NS['m']}}}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_BROKEN = (ValueError, KeyError, TypeError, AttributeError, IndexError, OverflowError, EOFError, NotImplementedError, RuntimeError, zlib.error, zipfile.BadZipFile, ElementTree.ParseError)
_BATCH = 20_000


def _address(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)([0-9]+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The numbers of cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode") or "").lower() for f in root.iter(f"{_M}numFmt")}
    is_date = lambda k: 14 <= k <= 17 or k == 22 or bool(re.search("[yd]", own.get(k, "")))
    formats = root.find("m:cellXfs", _NS)
    return {k for k, xf in enumerate(formats if formats is not None else []) if is_date(int(xf.get("numFmtId") or 0))}


def iso(at: datetime) -> str:
    return at.date().isoformat() if at.time() == datetime.min.time() else at.isoformat(sep=" ", timespec="seconds")


def _number(text: str) -> str:
    """A stored number without an exponent."""
    if re.fullmatch(r"-?[0-9]+", text):
        return text
    x = float(text)
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError(text)
    return str(int(x)) if x.is_integer() else format(Decimal(repr(x)), "f")


def _typed(text: str, style: int, dates: set[int], epoch: datetime) -> tuple[str, str]:
    """(value, type) of a stored number."""
    if style in dates:
        try:
            return iso(epoch + timedelta(days=float(text))), "date"
        except (OverflowError, ValueError):
            pass
    try:
        return _number(text), "number"
    except ValueError:
        return text, "text"


def _shared(book: zipfile.ZipFile) -> list[str]:
    """The texts that cells refer to by number, without those of phonetic runs."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as source:
        for _, si in ElementTree.iterparse(source):
            if si.tag == f"{_M}si":
                found.append("".join(t.text or "" for part in si if part.tag != f"{_M}rPh" for t in part.iter(f"{_M}t")))
                si.clear()
    return found


def _elements(book: zipfile.ZipFile, part: str, tags: set[str]) -> Iterator[ElementTree.Element]:
    """The elements of a sheet as they end; rows that have been read are let go."""
    with book.open(part) as source:
        rows = None
        for event, x in ElementTree.iterparse(source, ("start", "end")):
            if event == "start":
                rows = x if x.tag == f"{_M}sheetData" else rows
            elif x.tag in tags:
                yield x
            if event == "end" and x.tag == f"{_M}row" and rows is not None:
                rows.clear()


def _cells(book: zipfile.ZipFile, part: str, shared: list[str], dates: set[int], epoch: datetime) -> Iterator[tuple]:
    """(row, col, value, type, span) in the order of the file."""
    place = (-1, -1)
    for c in _elements(book, part, {f"{_M}c", f"{_M}mergeCell"}):
        if c.tag == f"{_M}mergeCell":
            a, _, b = c.get("ref").partition(":")
            yield *_address(a), None, None, _address(b or a)
            continue
        value, inline, t = c.find("m:v", _NS), c.find("m:is", _NS), c.get("t")
        text = "".join(x.text or "" for x in inline.iter(f"{_M}t")) if inline is not None else value.text if value is not None else None
        kind = "text"
        if text is not None and t == "s":
            text = shared[int(text)]
        elif text is not None and t == "b":
            text, kind = "True" if text.strip() == "1" else "False", "boolean"
        elif text is not None and t == "d":
            text, kind = iso(datetime.fromisoformat(text.strip()).replace(tzinfo=None)), "date"
        elif text is not None and t in (None, "n") and text.strip():
            text, kind = _typed(text.strip(), int(c.get("s") or 0), dates, epoch)
        # a cell without an address follows the one before it
        row, col = place = _address(c.get("r")) if c.get("r") else (max(place[0], 0), place[1] + 1)
        text = (text or "").strip() or None
        yield row, col, text, kind if text else None, None


def parse_xlsx(data: bytes, max_rows: int | None = None) -> Iterator[tuple]:
    """Cached values of every worksheet and its merged ranges as rows of kind span; a sheet of more than max_rows is one row of kind oversized."""
    book = zipfile.ZipFile(io.BytesIO(data))
    xml = lambda name: ElementTree.fromstring(book.read(name))
    shared, dates = _shared(book), _date_styles(book)
    root = xml("xl/workbook.xml")
    properties = root.find("m:workbookPr", _NS)
    late = properties is not None and properties.get("date1904") in ("1", "true")
    epoch = datetime(1904, 1, 1) if late else datetime(1899, 12, 30)
    targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
    for k, sheet in enumerate(root.find("m:sheets", _NS)):
        name, part = sheet.get("name"), "xl/" + targets[sheet.get(_REL)].removeprefix("/xl/")
        if max_rows is not None:
            n = max((row + 1 for row, _, text, _, _ in _cells(book, part, shared, dates, epoch) if text), default=0)
            if n > max_rows:
                yield k, name, n, None, None, None, None, "oversized", None
                continue
        for row, col, text, kind, end in _cells(book, part, shared, dates, epoch):
            yield (k, name, row, col, None, *end, "span", None) if end else (k, name, row, col, text, None, None, "cell", kind)


_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32()}[t]) for n, t in (x.split() for x in CELLS.split(", "))])


def parse_workbooks(files: DataFrame, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Cells of XLSX workbooks given as (path, content); a workbook's cells are let go in batches."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for k in range(files.num_rows):
                path, digest, made, some = files.column("path")[k].as_py(), files.column("sha256")[k].as_py(), [], False
                try:
                    for x in parse_xlsx(files.column("content")[k].as_py(), max_rows):
                        made.append((path, digest, *x))
                        some = some or x[4] is not None or x[7] == "oversized"
                        if len(made) == _BATCH:
                            yield batch(made)
                            made = []
                    if not some:
                        raise ValueError("the file has no rows")
                except _BROKEN as e:
                    made.append((path, digest, 0, None, None, None, str(e), None, None, "error", None))
                if made:
                    yield batch(made)

    # one file a batch: its bytes are what a task holds
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInArrow(parse, CELLS)


def _csv(spark: SparkSession, path: str, max_rows: int | None) -> DataFrame:
    """Cells of the .csv files below path, in the columns of CELLS; a file is one sheet, named like it."""
    rows, sizes = delimited.read_rows(spark, path)
    sheet = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    out = join_small(rows, sizes, "path", "inner")
    over = F.lit(False) if max_rows is None else F.col("n_rows") > max_rows
    none = lambda t: F.lit(None).cast(t)
    cells = out.filter(~over & (F.col("n_rows") > 0)).select("path", none("string").alias("sha256"), F.lit(0).alias("sheet_idx"), sheet.alias("sheet"), F.col("row_idx").cast("int").alias("row_idx"), "col_idx", F.coalesce("error", "value").alias("value"), none("int").alias("r1"), none("int").alias("c1"), F.when(F.col("error").isNull(), "cell").otherwise("error").alias("kind"), F.when(F.col("value").isNotNull(), "text").alias("type"))
    odd = sizes.filter(over | (F.col("n_rows") == 0))
    empty = F.col("n_rows") == 0
    notes = odd.select("path", none("string").alias("sha256"), F.lit(0).alias("sheet_idx"), sheet.alias("sheet"), F.when(~empty, F.col("n_rows")).cast("int").alias("row_idx"), none("int").alias("col_idx"), F.when(empty, "the file has no rows").alias("value"), none("int").alias("r1"), none("int").alias("c1"), F.when(empty, "error").otherwise("oversized").alias("kind"), none("string").alias("type"))
    return cells.unionByName(notes)


def read_workbooks(spark: SparkSession, path: str, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Rows of kind cell, span, oversized (a sheet with too many rows, in row_idx, which is dropped) and error (value says why).

    max_rows None reads sheets of any length. Files of no bytes and of other types than .csv and .xlsx are rows of kind error. A file with
    a row of kind error may have cells as well, as other tasks read them: `sound` leaves them out.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    books = every.filter(F.lower("path").endswith(".xlsx"))
    read = parse_workbooks(books.select("path", "content"), max_rows)
    names = [unquote(re.sub("^file:/+", "file:/", n)) for n in every.inputFiles()]
    if any(n.lower().endswith(".csv") for n in names):
        read = read.unionByName(_csv(spark, path, max_rows))
    read = read.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    if not names:
        return read
    listed = spark.createDataFrame([(n,) for n in names], "path string").withColumn("other", ~F.lower("path").endswith(".csv") & ~F.lower("path").endswith(".xlsx"))
    seen = every.select("path", F.lit(True).alias("seen"))  # Spark's readers pass over files of no bytes
    odd = listed.join(seen, "path", "left").filter("other or seen is null")
    why = F.when(F.col("other"), "the file's type is not supported").otherwise("the file is empty")
    note = {"path": F.col("path"), "sheet_idx": F.lit(0), "value": why, "kind": F.lit("error")}
    return read.unionByName(odd.select(*[note.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in CELLS.split(", "))]))


def sound(rows: DataFrame) -> DataFrame:
    """The rows of files without an error."""
    return join_small(rows, rows.filter("kind = 'error'").select("path").distinct(), "path", "left_anti")


def write_xlsx(rows: list[list], name: str = "Sheet1") -> bytes:
    """A workbook of one sheet, for a result small enough to hand to a person: texts, numbers, dates and booleans as such."""

    def letters(c: int) -> str:
        return (letters(c // 26 - 1) if c >= 26 else "") + chr(65 + c % 26)

    def cell(at: str, v) -> str:
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float, Decimal)):
            return f'<c r="{at}"><v>{v}</v></c>'
        if isinstance(v, date):
            days = (v if isinstance(v, datetime) else datetime(v.year, v.month, v.day)) - datetime(1899, 12, 30)
            return f'<c r="{at}" s="1"><v>{days / timedelta(days=1)!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{r + 1}">' + "".join(cell(f"{letters(c)}{r + 1}", v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
    main, office = _NS["m"], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet_type}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{sheet_type}.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{sheet_type}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for part, text in parts.items():
            book.writestr(part, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def write_table(df: DataFrame, folder: str, name: str, run_id: str) -> DataFrame:
    """df as the run's part of a table below folder, read again. Writing a run's part once more replaces it, also by one without rows."""
    path = f"{folder}/{name}/run_id={run_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tables(cleaned: DataFrame, audit: DataFrame, folder: str, run_id: str) -> None:
    """The cleaned grid and the audit log as Parquet, by run."""
    write_table(cleaned, folder, "cleaned", run_id)
    write_table(audit, folder, "audit", run_id)
