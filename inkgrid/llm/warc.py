"""WARC archives: a deduplicating writer and a Python data source.

Writing: every page becomes a record of its own gzip member. Among pages with equal payloads of REVISIT bytes or more, the
one with the largest page_id is a response; the others are revisit records that refer to it and carry digest and length
of the payload but not the payload. Smaller payloads are all responses. Rows that tie for the largest page_id are all
responses, a page without id is never referred to unless its whole group has none (then all its rows are responses),
and a null html is an empty payload. Each task writes files of its own attempt; _MANIFEST names those of the attempts
that succeeded, so files of lost executors or repeated tasks are not read.

Reading: spark.read.format("warc") plans byte ranges of the files as partitions. Predicates on record_type and on the
header columns are evaluated on a record's headers, which are inflated first; records that fail are skipped by the
length their gzip member states (others are inflated to their end), and payloads are not decoded with payload=false.
A gzip member may hold any number of records.

What is damaged (headers without end within HEADER bytes, a Content-Length that is no number, a record or member cut off,
bytes that don't inflate, anything but a record where one should begin) becomes a row that has only file and an
"x-error" among headers, and reading goes on at the next gzip member or, in plain files, the next line that begins a
record; with mode=FAILFAST it raises. Such rows have no record_type, so predicates on header columns leave them out.
"""

from __future__ import annotations

import base64
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from inkgrid.session import map_arrow, ship

#: Bytes of the least payload that may be revisited, of a file when the next one begins, and of a partition when read.
REVISIT, ROLL, RANGE = 1000, 256 << 20, 64 << 20
#: Bytes of the longest headers of a record.
HEADER = 1 << 20
#: The WARC-Profile of revisits with equal payload, and the magic and subfield of gzip members.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, SKIP = b"\x1f\x8b\x08", b"sl"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ID = "urn:x-page:"
#: The headers that have columns of their own.
COLUMNS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length",
}
SCHEMA = "file string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", headers map<string, string>, payload binary"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member that states its own compressed and raw lengths, where 32 bits hold them."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(record)) >= 1 << 32:
        return MAGIC + b"\0\0\0\0\0\0\xff" + body + tail
    return MAGIC + b"\4\0\0\0\0\0\xff" + struct.pack("<H", 12) + SKIP + struct.pack("<HII", 8, total, len(record)) + body + tail


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    own = page_id if page_id is not None else f"none-{uuid.uuid4()}"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{ID}{own}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="".join(map(chr, range(0x21, 0x7F))))))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Payload-Length", str(len(payload)))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> int:
    """Writes page_id, url and html of pages as WARC files in path; gives the number of files."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"), F.xxhash64(payload).alias("second"))
    large = rows.where(F.octet_length("payload") >= REVISIT)
    same = ["digest", "bytes", "second"]  # payloads are taken as equal when two digests and the length are
    copies = large.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last")).where("n > 1 and last is not null")
    # copies has a row for a payload; one with many pages is a skewed key of this join only, which adaptive execution splits
    marked = rows.join(copies.select(*same, "last"), same, "left")
    marked = marked.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))
    files = [r.file for r in map_arrow(marked, _writer(path, date), "file string").collect()]
    system, root = file_system(path)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/_MANIFEST") as out:
        out.write("\n".join(sorted(files)).encode())
    return len(files)


def _writer(path: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = file_system(path)
        system.create_dir(root, recursive=True)
        stem, files, out, size = f"part-{context.partitionId():05d}-{context.taskAttemptId()}", [], None, 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or size >= ROLL:
                    if out is not None:
                        out.close()
                    files.append(f"{stem}-{len(files):04d}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                data = member(record(page_id, url, payload, digest, refers_to, date))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], ["file"])

    return run


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class WarcSource(DataSource):
    """Options: path (a folder, or a file), payload (false leaves payloads out), range (bytes of a partition), mode (FAILFAST raises where a file is damaged)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.range = int(options.get("range", RANGE))
        self.strict = str(options.get("mode", "")).upper() == "FAILFAST"
        self.wanted: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in COLUMNS and isinstance(f, EqualTo):
                self.wanted.append((column, frozenset([f.value])))
            elif column in COLUMNS and isinstance(f, In):
                self.wanted.append((column, frozenset(f.value)))
            elif column in COLUMNS and isinstance(f, IsNotNull):
                self.wanted.append((column, None))
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, root = file_system(self.path)
        info = system.get_file_info(root)
        if info.is_file:
            files = [info]
        else:
            files = [f for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith((".warc", ".warc.gz"))]
            if system.get_file_info(f"{root}/_MANIFEST").is_file:
                with system.open_input_stream(f"{root}/_MANIFEST") as f:
                    listed = set(f.read().decode().split("\n"))
                files = [f for f in files if f.base_name in listed]
        cut = lambda f: range(0, f.size, self.range) if f.base_name.endswith(".gz") else range(min(1, f.size))
        return [Range(f.path, at, min(at + self.range, f.size) if f.base_name.endswith(".gz") else f.size) for f in sorted(files, key=lambda f: f.path) for at in cut(f)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = file_system(self.path)
        rows, size = [], 0
        with system.open_input_file(partition.file) as f:
            for headers, payload in self._records(f, partition):
                rows.append((partition.file, *(_value(c, headers) for c in COLUMNS), list(headers.items()), payload))
                size += len(payload or b"") + 1000
                if size >= 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _keep(self, headers: dict[str, str]) -> bool:
        return all((v := _value(c, headers)) is not None and (allowed is None or v in allowed) for c, allowed in self.wanted)

    def _records(self, f: pa.NativeFile, part: Range) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """The wanted records of the members (or, in plain files, records) that begin in a range of bytes."""
        zipped = part.file.endswith(".gz")
        at = _next_member(f, part.start, part.end) if zipped and part.start else part.start
        while at is not None and at < part.end:
            source = Source(f, at, zipped)
            try:
                while (headers := source.headers()) is not None:
                    length = headers.get("content-length", "")
                    if not re.fullmatch("[0-9]{1,18}", length):
                        raise Damaged(f"Content-Length is {length!r}")
                    payload = None
                    if self._keep(headers):
                        if self.payload and headers.get("warc-type") != "revisit":
                            block = source.read(int(length))
                            payload = block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block
                        elif not source.whole(int(length)):
                            source.skip(int(length))
                        yield headers, payload
                    if source.whole(int(length)):
                        break
                    source.skip(int(length))
                at = source.end()
            except (Damaged, zlib.error) as e:
                if self.strict:
                    raise ValueError(f"{part.file} from byte {at} on: {e}") from e
                if self._keep(error := {"x-error": str(e)}):
                    yield error, None
                at = _next_member(f, at + 1, part.end) if zipped else _next_record(f, source.begun + 1)


def _value(column: str, headers: dict[str, str]) -> str | None:
    value = headers.get(COLUMNS[column])
    if value is not None and column == "payload_digest" and re.fullmatch("(?i)sha1:[A-Z2-7]{32}", value):
        return base64.b32decode(value[5:].upper()).hex()
    return value


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [pa.string()] * (1 + len(COLUMNS)) + [pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", *COLUMNS, "headers", "payload"])


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines[1:]) if colon}


class Damaged(Exception):
    """What is read isn't a whole record."""


class Source:
    """The records of a gzip member, or of the rest of a plain file, one after the other; only as much is inflated as is asked for."""

    def __init__(self, f: pa.NativeFile, at: int, zipped: bool) -> None:
        self.f, self.at, self.taken, self.waiting, self.data = f, at, 0, b"", bytearray()
        self.zip = zlib.decompressobj(31) if zipped else None
        #: Where the record at hand begins (in plain files), its own length so far, and the compressed and raw length that the member states.
        self.begun, self.body, self.stated, self.first = at, 0, None, True
        if zipped:
            f.seek(at)
            self.waiting = f.read(8192)
            self.taken = len(self.waiting)
            if self.taken > 24 and self.waiting[3] & 4 and self.waiting[12:14] == SKIP:
                stated = struct.unpack("<II", self.waiting[16:24])
                self.stated = stated if at + stated[0] <= f.size() else None

    def _more(self, most: int) -> bool:
        """Adds up to most bytes to data; False at the end of the member or file."""
        if self.zip and self.zip.eof:
            return False
        if not self.waiting:
            self.f.seek(self.at + self.taken)
            self.waiting = self.f.read(1 << 18 if self.zip else most)
            self.taken += len(self.waiting)
            if not self.waiting:
                if self.zip:
                    raise Damaged("the member is cut off")
                return False
        if self.zip:
            self.data += self.zip.decompress(self.waiting, most)
            self.waiting = self.zip.unconsumed_tail
        else:
            self.data += self.waiting
            self.waiting = b""
        return True

    def headers(self) -> dict[str, str] | None:
        """The headers of the next record; None where none follows."""
        while True:
            blank = len(self.data) - len(self.data.lstrip(b"\r\n"))
            self.data, self.begun = self.data[blank:], self.begun + blank
            if len(self.data) >= 5:
                break
            if not self._more(4096):
                if self.data:
                    raise Damaged("no record begins here")
                return None
        if not self.data.startswith(b"WARC/"):
            raise Damaged("no record begins here")
        while (cut := self.data.find(b"\r\n\r\n")) < 0:
            if len(self.data) > HEADER or not self._more(4096):
                raise Damaged("headers without end")
        self.body = cut + 4
        return _parse(bytes(self.data[:cut]))

    def read(self, length: int) -> bytes:
        while (left := self.body + length - len(self.data)) > 0:
            if not self._more(left):
                raise Damaged("the record is cut off")
        return bytes(self.data[self.body : self.body + length])

    def whole(self, length: int) -> bool:
        """Whether the member says that it holds just this record, so that its end needs no inflating."""
        return self.stated is not None and self.first and self.stated[1] == self.body + length + 4

    def skip(self, length: int) -> None:
        """Goes to the end of the record, once."""
        left = self.body + length
        if self.body == 0:
            return
        if self.zip:
            while left > len(self.data):
                left -= len(self.data)
                self.data = bytearray()
                if not self._more(min(left, 1 << 20)):
                    raise Damaged("the record is cut off")
            self.data = self.data[left:]
        elif left <= len(self.data):
            self.data = self.data[left:]
        else:  # a plain file is not read through
            if self.f.size() < self.begun + left:
                raise Damaged("the record is cut off")
            self.taken, self.data, self.waiting = self.begun + left - self.at, bytearray(), b""
        self.begun += self.body + length
        self.body, self.first = 0, False

    def end(self) -> int | None:
        """Where the next member begins; a plain file is read to its end at once."""
        if not self.zip:
            return None
        if self.stated is not None and self.first:
            return self.at + self.stated[0]
        while not self.zip.eof:
            self.data = bytearray()
            self._more(1 << 20)
        return self.at + self.taken - len(self.zip.unused_data)


def _next_record(f: pa.NativeFile, start: int) -> int | None:
    """Where the next line of a plain file that begins a record is."""
    at, window = start, 1 << 20
    while at < f.size():
        f.seek(at)
        k = f.read(window + 16).find(b"\nWARC/1.")
        if k >= 0:
            return at + k + 1
        at += window
    return None


def _next_member(f: pa.NativeFile, start: int, end: int) -> int | None:
    """The first member of a record that begins in a range: a gzip magic whose contents begin with a WARC version."""
    at, window = start, 1 << 16
    while at < end:
        f.seek(at)
        data = f.read(window + 4096)
        k = data.find(MAGIC)
        while 0 <= k < window:
            try:
                if at + k < end and zlib.decompressobj(31).decompress(data[k:], 8).startswith(b"WARC/"):
                    return at + k
            except zlib.error:
                pass
            k = data.find(MAGIC, k + 1)
        at += window
    return None


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of the WARC files in path, with predicate pushdown on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark)
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def page_number(record_id: str):
    """The page_id in a column of record ids; null where it has none."""
    return F.regexp_extract(record_id, f"^<{ID}(-?[0-9]+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes pages and reads the records back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Lengths and digests of responses come from the payloads read back, those of revisits from their headers.
    """
    write(pages, path)
    back = read(pages.sparkSession, path)
    own = F.col("record_type") == "response"
    return back.select(
        page_number("record_id").alias("page_id"),
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length").cast("long")).alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page_number("refers_to").alias("refers_to"),
    )
