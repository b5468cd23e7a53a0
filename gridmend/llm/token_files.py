"""Token ids as Parquet: list columns that can be read by document or by metadata alone.

`write_tokens` deals the texts out by ranges of doc_id, encodes each range in order and writes one file a range: doc_id
and the running count are delta encoded, the ids, of which a vocabulary has few, are dictionary encoded, row groups and
pages have fixed sizes, and Parquet's page index lets a reader skip to the pages of the documents that it wants.
`read_metadata` touches no ids; `read_tokens` reads the ids, of all documents or of a range.

A file stores where each document starts within its own range. The number of ids before a range is a sum over one row per
range, added when the files are read, so texts are encoded once and nothing but those rows is gathered.

Defined results: a null or empty text has the end id alone. Documents are in ascending order of doc_id, a null doc_id first;
rows with one doc_id are in the order of their texts' MD5, over all files, and equal rows follow each other. A doc_id must be an
integer. No documents give empty files. Other columns of the input aren't stored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digest, join_small
from .piece_table import TableEncoder
from .textarrays import texts
from .token_counts import byte_letters

END_ID = 2
#: Bytes; a page is the least that a selective read takes.
ROW_GROUP, PAGE, DICTIONARY = 32 << 20, 128 << 10, 512 << 10
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType(), False), T.StructField("place", T.LongType(), False), T.StructField("start_in_part", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])


class Encoder(TableEncoder):
    """The tokenizers library behind a table of pieces: each distinct piece is encoded by it once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        by_letter = {c: i for i, c in enumerate(byte_letters())}
        by_id = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            by_id[i] = token.encode() if token.encode() in self.special else bytes([by_letter[c] for c in token])
        super().__init__(self.library, by_id)

    def library(self, pieces: list[bytes]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in made]

    def encode_ended(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the place at which each text ends, after a 0."""
        data = raw.tobytes()
        if any(s in data for s in self.special):  # the library splits texts at these strings, then into pieces
            bounds = offsets.tolist()
            own = [np.frombuffer(x, "<u4") for x in self.library([data[a:b] for a, b in zip(bounds, bounds[1:])])]
            ids, ends = np.concatenate(own), np.append(0, np.cumsum(list(map(len, own))))
        else:
            ids, ends = self.encode(raw, offsets)
        return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker, however many tasks it runs."""
    return Encoder(path)


def _writer(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        place = tokens = 0
        for batch in batches:
            for a, b, raw, offsets in texts(batch.column("text")):
                ids, ends = own.encode_ended(raw, offsets, end_id)
                counts = np.diff(ends)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("part").slice(a, b - a), pa.array(place + np.arange(b - a)), pa.array(tokens + ends[:-1]), pa.array(counts), ids], names=SCHEMA.names)
                place, tokens = place + b - a, tokens + int(ends[-1])

    return encode


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Writes the token files of docs below path."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest(F.coalesce("text", F.lit(""))).alias("_digest"), F.monotonically_increasing_id().alias("_place"))
    # the place parts equal rows, which may be a third of all; those are alike wherever they go
    order = ["doc_id", "_digest", "_place"]
    dealt = keyed.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    made = dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(_writer(tokenizer, end_id), SCHEMA)
    options = {
        "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.dictionary.page.size": DICTIONARY, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "compression": "zstd", "parquet.compression.codec.zstd.level": "1",
    }
    made.write.options(**options).parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of each document; no page of ids is read."""
    return _with_start(spark, path, _files(spark, path).drop("ids"))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids, of all documents or of those from doc_id first to last."""
    rows = _files(spark, path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return _with_start(spark, path, rows)


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    # one row per file meets in one task, whatever the number of documents
    totals = _files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    out = join_small(rows, base, F.col("part") == F.col("_part"), "left")
    return out.select("doc_id", (F.col("_base") + F.col("start_in_part")).alias("start"), "n_tokens", *[c for c in rows.columns if c == "ids"])


@F.arrow_udf(T.LongType())
def ids_crc32(column: pa.Array) -> pa.Array:
    """The unsigned CRC-32 of each list's ids as little-endian unsigned 32-bit integers."""
    ids = column.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    ends = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).tolist()
    return pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.int64())
