"""Delimited text files as rows, each file read by as many tasks as it has splits.

Spark's text source deals a file's lines to tasks by byte ranges. Where a task's lines begin in a quoted field, and which row they are, isn't known
from the range alone; but each line maps "outside quotes" and "inside quotes" to where it leaves off, and such maps compose. So

1. the first split of each file tells its dialect,
2. every split gives a row: where it leaves off and how many rows it begins, from either state (nothing else of it is kept),
3. the rows of a file's splits are folded in order into each split's state and first row number, and
4. the splits are read again, and parsed. Rows of several lines, which may cross splits, are put together by their number.

A task holds one batch of lines; no file, sheet or split is held whole.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.scratch import join_small, written

SNIFF = 64 << 10
DIALECT = "delimiter string, quote string, doubled boolean, spaced boolean"
_ROWS = "path string, row_idx long, col_idx int, value string, error string, block long, line long, text binary"


def sniffed(head: bytes) -> tuple[str, str, bool, bool]:
    """(delimiter, quote, whether quotes are doubled inside quotes, whether blanks after a delimiter don't count) of a file that begins so."""
    try:
        found = csv.Sniffer().sniff(head.decode("utf-8-sig", "replace")[:SNIFF], ",;\t|")
    except csv.Error:
        found = csv.excel
    return found.delimiter, found.quotechar or '"', bool(found.doublequote), bool(found.skipinitialspace)


class Quoting:
    """Whether a line leaves off inside quotes, from whether it begins there."""

    def __init__(self, delimiter: str, quote: str, doubled: bool, spaced: bool):
        self.delimiter, self.quote, self.doubled, self.spaced = delimiter, quote, doubled, spaced
        self.marks = re.compile(f"[{re.escape(delimiter)}{re.escape(quote)}]")

    def after(self, line: str, inside: bool) -> bool:
        if self.quote not in line:
            return inside
        begins, skip = 0, -1  # where the field at hand begins; -1 once it has begun otherwise
        for m in self.marks.finditer(line):
            at = m.start()
            if at == skip:
                continue
            if inside:
                if m[0] == self.quote:
                    if self.doubled and line[at + 1 : at + 2] == self.quote:
                        skip = at + 1
                    else:
                        inside, begins = False, -1
            elif m[0] == self.delimiter:
                begins = at + 1
            elif begins >= 0 and (at == begins or self.spaced and not line[begins:at].strip(" ")):
                inside = True
            else:
                begins = -1
        return inside

    def reader(self, lines: list[str]) -> Iterator[list[str]]:
        return csv.reader(lines, delimiter=self.delimiter, quotechar=self.quote, doublequote=self.doubled, skipinitialspace=self.spaced)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(text, path, block): the lines of .csv files below path; block is where a line's split begins."""
    source = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]").load(path)
    # the path is told as a URL; a plus in it is no blank
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return source.select(F.col("value").cast("binary").alias("text"), path.alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, head, size = None, [], 0
    made = []
    for batch in batches:
        for text, path in zip(batch.column("text"), batch.column("path").to_pylist()):
            if path != now:
                if now is not None:
                    made.append((now, *sniffed(b"\n".join(head))))
                now, head, size = path, [], 0
            if size < SNIFF:
                head.append(text.as_py() or b"")
                size += len(head[-1]) + 1
    if now is not None:
        made.append((now, *sniffed(b"\n".join(head))))
    yield _batch(made, f"path string, {DIALECT}")


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, int, Quoting, str]]:
    """(path, block, quoting, line) of lines with their dialects; a mark of byte order at a file's start is no text."""
    last, quoting = None, None
    columns = [batch.column(c).to_pylist() for c in ("path", "block", "delimiter", "quote", "doubled", "spaced", "text")]
    for path, block, *dialect, text in zip(*columns):
        if dialect != last:
            last, quoting = dialect, Quoting(*dialect)
        yield path, block, quoting, (text or b"").decode("utf-8", "replace")


_SPLITS = "path string, block long, lines long, out0 boolean, out1 boolean, begun0 long, begun1 long, last0 long, last1 long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a split: from outside (0) and inside (1) quotes, where it leaves off, how many rows it begins and which of those is the last with anything in it."""
    now, state, made = None, None, []
    for batch in batches:
        for path, block, quoting, line in _texts(batch):
            if (path, block) != now:
                if now:
                    made.append((*now, *state))
                now, state = (path, block), [0, False, True, 0, 0, -1, -1]
            some = bool(line.strip(quoting.delimiter + quoting.quote + " \t\r﻿"))
            state[0] += 1
            for k in (0, 1):
                if not state[1 + k]:
                    state[3 + k] += 1
                if some:
                    state[5 + k] = state[3 + k]
            out = quoting.after(line, state[1])
            state[1], state[2] = out, out if state[1] == state[2] else quoting.after(line, state[2])
    if now:
        made.append((*now, *state))
    yield _batch(made, _SPLITS)


_STARTS = "path string, block long, inside boolean, first_row long, n_rows long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each file's splits in order, where each begins; n_rows counts a file's rows up to the last with anything in it."""
    for batch in batches:
        made = []
        for path, splits in zip(batch.column("path").to_pylist(), batch.column("splits").to_pylist()):
            inside, row, n_rows, own = False, 0, 0, []
            for s in splits:
                k = int(inside)
                own.append((path, s["block"], inside, row))
                if s[f"last{k}"] >= 0:
                    n_rows = row + s[f"last{k}"]
                inside, row = s[f"out{k}"], row + s[f"begun{k}"]
            made += [(*x, n_rows) for x in own]
        yield _batch(made, _STARTS)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of rows that are one line, and the lines of the others as they are."""
    now, inside, row, n = None, False, 0, 0
    for batch in batches:
        made, whole, quoting = [], [], None

        def flush():
            for (path, at), line in whole:
                try:
                    for values in quoting.reader([line]):
                        made.extend((path, at, c, v.strip() or None, None, None, None, None) for c, v in enumerate(values))
                except csv.Error as e:
                    made.append((path, at, None, None, str(e), None, None, None))
            whole.clear()

        starts = zip(batch.column("inside").to_pylist(), batch.column("first_row").to_pylist())
        for (path, block, q, line), (begins, first) in zip(_texts(batch), starts):
            if (path, block) != now:
                now, inside, row, n = (path, block), begins, first, 0
            if block == 0 and n == 0:
                line = line.removeprefix("﻿")
            if q is not quoting:
                flush()
                quoting = q
            row += not inside
            out = q.after(line, inside)
            if inside or out:
                made.append((path, row - 1, None, None, None, block, n, line.encode()))
            else:
                whole.append(((path, row - 1), line))
            inside, n = out, n + 1
        flush()
        yield _batch(made, _ROWS)


def _parse_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of rows of several lines."""
    for batch in batches:
        made = []
        columns = [batch.column(c).to_pylist() for c in ("path", "row_idx", "delimiter", "quote", "doubled", "spaced", "parts")]
        for path, row, *dialect, parts in zip(*columns):
            try:
                values = next(Quoting(*dialect).reader([p["text"].decode("utf-8", "replace") + "\n" for p in parts]), [])
                made += [(path, row, c, v.strip() or None, None, None, None, None) for c, v in enumerate(values)]
            except csv.Error as e:
                made.append((path, row, None, None, str(e), None, None, None))
        yield _batch(made, _ROWS)


def read_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, row_idx, col_idx, value, error) of every cell of the .csv files below path, and (path, n_rows) of the files."""
    lines = lines_of(spark, path)
    dialects = written(lines.filter("block = 0").mapInArrow(_heads, f"path string, {DIALECT}"), "dialects")
    told = _in_order(lines, dialects, ["path"])
    splits = told.mapInArrow(_summaries, _SPLITS).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", *[x.split()[0] for x in _SPLITS.split(", ")[2:]]))).alias("splits"))
    starts = written(splits.mapInArrow(_fold, _STARTS), "splits")  # a row for each split of a file
    parsed = _in_order(told, starts.drop("n_rows"), ["path", "block"]).mapInArrow(_parse, _ROWS)
    cells = written(parsed, "csv-cells")
    several = cells.filter("text is not null").groupBy("path", "row_idx").agg(F.sort_array(F.collect_list(F.struct("block", "line", "text"))).alias("parts"))
    long = join_small(several, dialects, "path", "inner").mapInArrow(_parse_long, _ROWS)
    both = cells.filter("text is null").unionByName(long).select("path", "row_idx", "col_idx", "value", "error")
    return both, starts.groupBy("path").agg(F.max("n_rows").alias("n_rows"))


def _in_order(lines: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """lines with the row of small for their file or split, in their order. Beyond what may be broadcast, splits are dealt and sorted anew."""
    if small.limit(SPLITS_AT_ONCE + 1).count() <= SPLITS_AT_ONCE:
        return lines.join(F.broadcast(small), on)
    if "line" not in lines.columns:
        lines = lines.withColumn("line", F.monotonically_increasing_id())  # grows with the lines of a split
    return lines.join(small, on).repartition("path", "block").sortWithinPartitions("path", "block", "line")


#: Splits whose states may be broadcast; beyond it they are joined by shuffle.
SPLITS_AT_ONCE = 200_000
