"""WARC archives: a writer that stores repeated payloads once, and a splittable reader.

`write_warc` gives each page a gzip member of its own with one WARC record. Of pages with equal payloads (by SHA-1) the one with
the largest page_id becomes a response and the others revisit records, which have the digest and length of the payload and refer
to the response. The largest id of a digest is found with partial sums and written before pages are joined with it, so adaptive
execution may split the pages of one payload among tasks, however many share it. Each task writes files of its own name, so a task that is run again leaves at most a file that no list names: the
result of `write_warc` is the list of files whose tasks ended well.

`read_warc` cuts files into byte ranges, a task each. A task seeks to its range, looks for the magic bytes of gzip, and takes a
place for a member if what it decodes to begins with a WARC version line and ends in a whole record; it owns the records that
start inside its range, and reads past its end to finish the last. Compressed data that happens to hold the magic bytes doesn't
decode to that. Payloads are digested as they are decoded and are checked against the record's own digest. What isn't a whole
record gives a row of record_type `damaged`, with the place and nulls: a member that begins like a record but doesn't end as one,
and bytes after a record, or at a file's start, that no member begins with. Each is the row of one task only.

Files are opened through Arrow's file systems by the URI of the shared folder, on whatever store that is.

Defined results: a null or empty html is an empty payload; empty payloads are equal like others. Rows that repeat page_id and
payload are each a response; a null page_id never wins over another, and if all pages of a payload lack one, all are responses. A
page_id must be an integer. No pages give no files. Other columns of pages aren't stored, but for url.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES, FILE_BYTES, READ = 8 << 20, 64 << 20, 1 << 17
MAX_READ_TASKS = 20_000
_FILES = "path string, bytes long, n_records long"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, valid boolean, path string, at long, payload binary"


def digest_text(sha1: bytes) -> str:
    """Bare upper-case base32."""
    return base64.b32encode(sha1).decode()


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _page_id(uri: str | None) -> int | None:
    return int(uri.rpartition(":")[2]) if uri and uri.rpartition(":")[2] else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None, revisit: bool) -> bytes:
    """A gzip member with the WARC record of a page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_uri(page_id)}>", f"WARC-Target-URI: {(url or '').translate({13: 32, 10: 32})}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_uri(response)}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, path, done = None, "", []
        size = n = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                payload = (row["html"] or "").encode()
                member = record(row["page_id"], row["url"], payload, digest_text(bytes(row["sha1"])), row["response"], row["revisit"])
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "n_records"])

    return write


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives of page_id, url and html below folder, and returns path, bytes and n_records of each file."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    sha1 = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", sha1.alias("sha1"))
    winners = rows.groupBy(F.col("sha1").alias("_sha1")).agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    many = cut(winners.filter("n > 1").drop("n"), "warc-repeated")
    joined = rows.join(many.hint("shuffle_hash"), F.col("sha1") == F.col("_sha1"), "left")
    revisit = F.col("response").isNotNull() & ~F.col("response").eqNullSafe(F.col("page_id"))
    dealt = joined.select("page_id", "url", "html", "sha1", "response", revisit.alias("revisit"))
    return cut(dealt.mapInArrow(_writer(folder, file_bytes), _FILES), "warc-files")


class _Ahead:
    """Reads a file forward from a place, holding what hasn't been let go of."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held, self.ended = file, at, bytearray(), False
        file.seek(at)

    def more(self) -> bool:
        data = b"" if self.ended else self.file.read(READ)
        self.ended |= not data
        self.held += data
        return bool(data)

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n

    def reach(self, n: int) -> int:
        """Reads on until n bytes are held or the file ends; how many of them there are."""
        while len(self.held) < n and self.more():
            pass
        return min(len(self.held), n)


def _member(source: _Ahead, start: int, only_begin: bool = False) -> tuple[bytes | None, int]:
    """The decoded member at held[start:] and its compressed length; if it isn't whole, None and 1 if it begins as a record, else 0."""
    unpacker, out, at, begun = zlib.decompressobj(31), [], start, b""
    while not unpacker.eof:
        if at >= len(source.held) and not source.more():
            return None, int(begun == b"WARC/")
        try:
            piece = unpacker.decompress(bytes(source.held[at : at + READ]))
        except zlib.error:
            return None, int(begun == b"WARC/")
        at = min(at + READ, len(source.held))
        out.append(piece)
        begun = (begun + piece[:5])[:5]
        if begun != b"WARC/"[: len(begun)]:
            return None, 0
        if only_begin and len(begun) == 5:
            return None, 1
    return b"".join(out), at - len(unpacker.unused_data) - start


def parse(data: bytes) -> dict | None:
    """The fields of a record, or None if its header or length is not that of a whole record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}
    if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
        return None
    length = int(fields["content-length"])
    if len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    return fields | {"payload": rest[:length].partition(b"\r\n\r\n")[2]}


def scan(file, start: int, end: int) -> Iterator[tuple[int, dict | None]]:
    """(place, fields) of the records whose members start in [start, end), and (place, None) of what is damaged there."""
    source = _Ahead(file, start)
    due = 0 if start == 0 else None  # where a record must begin; None while that isn't known
    while source.at < end:
        while (k := source.held.find(MAGIC)) < 0 and source.at + len(source.held) < end + len(MAGIC) and source.more():
            pass
        if k < 0 or source.at + k >= end:
            break
        source.drop(k)
        data, length = _member(source, 0)
        fields = parse(data) if data is not None else None
        if fields is not None:
            if due is not None and due != source.at:
                yield due, None
            yield source.at, fields
            due = source.at + length
            source.drop(length)
        elif data is not None or length:
            yield source.at, None  # begins as a record, but isn't one
            due = None
            source.drop(1)
        else:
            source.drop(1)  # the magic bytes stood inside something else
    if due is not None and (left := source.reach(due - source.at + 1) - (due - source.at)) > 0:
        # the next record belongs to whoever reads on from here; other bytes are damage
        if due < end or not _member(source, due - source.at, only_begin=True)[1]:
            yield due, None


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
        store, _ = fs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for split in batch.to_pylist():
                with store.open_input_file(split["path"]) as file:
                    for at, f in scan(io.BufferedReader(file, READ), split["start"], split["end"]):
                        if f is None:
                            rows.append((None, None, "damaged", None, None, None, False, split["path"], at, None))
                            continue
                        revisit = f.get("warc-type") == "revisit"
                        stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
                        digest = stated if revisit else digest_text(hashlib.sha1(f["payload"]).digest())
                        length = int(f.get("x-payload-length", 0)) if revisit else len(f["payload"])
                        refers = _page_id(f["warc-refers-to"].strip("<>")) if "warc-refers-to" in f else None
                        rows.append((_page_id(f.get("warc-record-id", "").strip("<>")), f.get("warc-target-uri"), f.get("warc-type"), refers, length, digest, digest == stated, split["path"], at, f["payload"] if with_payload and not revisit else None))
                        size += len(f["payload"]) if with_payload else 100
                        if size > 4 << 20:
                            yield made()
                            rows.clear()
                            size = 0
        yield made()

    return read


def read_warc(spark: SparkSession, folder: str, files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """A row per record of the files (path, bytes) below folder; valid says whether a payload has the record's digest."""
    splits = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    wanted = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    dealt = splits.repartition(int(min(wanted, MAX_READ_TASKS)))  # a number, as these few bytes stand for much work
    return dealt.mapInArrow(_reader(folder, with_payload), _RECORDS)
