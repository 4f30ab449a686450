"""WARC archives: a writer that turns repeated payloads into revisit records, and a Spark data source.

Writing: payloads are compared by SHA-1; of equal ones the one with the smallest page_id becomes the
response record and the others revisit it. Every partition writes archives of about ARCHIVE_BYTES to a folder all
executors share, in a fixed order and under temporary names first, so a repeated task replaces its own files.
Compressed archives hold one gzip member a record, and the member's header says how long the member is (the
skip-lengths field of the standard's annex on compression).

Reading: format("warc") plans partitions of whole archives by size. Filters on record type and on other
header fields are pushed into the reader. It inflates and parses a record's header first, and steps over the rest
of a record that the filters drop, or whose payload no wanted column needs, without reading or inflating it. Compressed archives of
other writers lack the field; their records are read through instead.

Defined results: a null payload is the empty payload; null urls leave out the header; rows that
repeat the page_id and payload of a response are responses too; null ids sort last; an empty table
writes no archive and reads back as no rows; payloads may have any length; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from provena.llm.common import materialise

IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs
DATE = "2024-01-01T00:00:00Z"
PARTITION_BYTES = 64 << 20
ARCHIVE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20


def record_id(page_id: object, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, f'{kind}|{page_id}|{digest}')}>"


def response_record(page_id: object, url: str | None, payload: bytes, digest: str, date: str = DATE) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return _record("response", page_id, url, digest, date, [], block)


def revisit_record(page_id: object, url: str | None, digest: str, first_id: object, date: str = DATE) -> bytes:
    more = [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", record_id(first_id, digest, "response")),
    ]
    if first_id is not None:
        more.append(("X-Refers-To-Page-Id", str(first_id)))
    return _record("revisit", page_id, url, digest, date, more, b"HTTP/1.1 200 OK\r\n\r\n")


def _record(kind: str, page_id: object, url: str | None, digest: str, date: str, more: list, block: bytes) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, kind)), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", "".join(url.split())))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), *more]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member whose header holds its own length and the record's (zero where they need over 32 bits)."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 32 + len(body)
    lengths = (size, len(record)) if max(size, len(record)) < 1 << 32 else (0, 0)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *lengths)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def member_length(head: bytes) -> int:
    """The length that a member's header holds, zero if none."""
    if head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 4 <= end:
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"sl" and size == 8:
            return int.from_bytes(head[at + 4 : at + 8], "little")
        at += 4 + size
    return 0


def with_roles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, sha1 hex, first_id) with the page_id of the response that has the same payload."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # Written first: a join with a table is one that AQE may split where many pages have one payload.
    first = materialise(rows.groupBy("sha1").agg(F.min("page_id").alias("first_id")), "first-pages")
    return rows.join(first, "sha1")


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, compress: bool = False, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write the pages' archives to folder; (path, n_records, n_bytes) of each archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        done: list[tuple[str, str, int, int]] = []
        out, n, size = None, 0, 0

        def close() -> None:
            nonlocal out, n, size
            if out is not None:
                out.close()
                done[-1] = (*done[-1][:2], n, size)
                out, n, size = None, 0, 0

        for batch in batches:
            for own, target, payload, sha1, first in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                if own == first or len(payload) < min_bytes:
                    record = response_record(own, target, payload, digest)
                else:
                    record = revisit_record(own, target, digest, first)
                record = member(record) if compress else record
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/part-{task.partitionId():06d}-{len(done):05d}.warc{'.gz' if compress else ''}"
                    done.append((f"{name}.{task.taskAttemptId()}.tmp", name, 0, 0))
                    out = fs.open_output_stream(done[-1][0])
                out.write(record)
                n, size = n + 1, size + len(record)
                if size >= archive_bytes:
                    close()
        close()
        for draft, name, _, _ in done:
            fs.move(draft, name)
        yield pa.RecordBatch.from_pydict({"path": [x[1] for x in done], "n_records": [x[2] for x in done], "n_bytes": [x[3] for x in done]}, schema=WRITTEN)

    rows = with_roles(pages, page_id, url, html).select("page_id", "url", F.col("html").cast("binary"), "sha1", "first_id")
    # In order, so that a repeated task cuts its archives at the same records.
    ordered = rows.sortWithinPartitions("sha1", "page_id", "url")
    return materialise(ordered.mapInArrow(write, "path string, n_records long, n_bytes long"), "archives")


WRITTEN = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


# --- reading ---------------------------------------------------------------------------------

SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("page_id", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("refers_to_page_id", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha1", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "page_id": "x-page-id",
    "refers_to": "warc-refers-to",
    "refers_to_page_id": "x-refers-to-page-id",
    "payload_digest": "warc-payload-digest",
}
FROM_BLOCK = {"payload_bytes", "payload_sha1", "payload"}


#: Bytes of a member that are read to find the end of its record's header.
HEAD = 2048


@dataclass
class Archives(InputPartition):
    files: list[str]


class WarcSource(DataSource):
    """spark.read.format("warc").schema(<some columns of SCHEMA>).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        unknown = set(self.columns) - set(SCHEMA.names)
        if unknown:
            raise ValueError(f"a WARC record has no {sorted(unknown)}")
        self.folder = options["path"]
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            at = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if at in HEADERS and isinstance(f, EqualTo):
                self.tests.append((HEADERS[at], "in", {f.value}))
            elif at in HEADERS and isinstance(f, In):
                self.tests.append((HEADERS[at], "in", set(f.value)))
            elif at in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((HEADERS[at], "starts", f.value))
            elif at in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((HEADERS[at], "there", None))
            else:
                yield f

    def partitions(self) -> list[Archives]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        bins: list[Archives] = []
        room = 0
        for path, size in files:
            if not bins or size > room:
                bins.append(Archives([]))
                room = self.partition_bytes
            bins[-1].files.append(path)
            room -= size
        return bins or [Archives([])]

    def wanted(self, header: dict[str, str]) -> bool:
        for name, how, value in self.tests:
            x = header.get(name)
            if x is None or how == "in" and x not in value or how == "starts" and not x.startswith(value):
                return False
        return True

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        need = bool(FROM_BLOCK & set(self.columns))
        kinds = {"content_length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        types = [kinds.get(c, pa.string()) for c in self.columns]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=self.columns)

        for path in partition.files:
            with fs.open_input_file(path) as raw:
                found = gzip_records(raw, self.wanted, need) if path.endswith(".gz") else records(io.BufferedReader(raw, 1 << 18), self.wanted, need)
                for header, payload in found:
                    row = {c: header.get(h) for c, h in HEADERS.items()}
                    row |= {"path": path, "content_length": length_of(header)}
                    if payload is not None:
                        row |= {"payload_bytes": len(payload), "payload": payload}
                        if "payload_sha1" in self.columns:
                            row["payload_sha1"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append(tuple(row.get(c) for c in self.columns))
                    held += 500 + (len(payload) if payload is not None and "payload" in self.columns else 0)
                    if held > BATCH_BYTES:
                        yield batch()
                        rows.clear()
                        held = 0
        if rows:
            yield batch()


class Members(io.RawIOBase):
    """The inflated bytes of a file of gzip members, front to back."""

    def __init__(self, raw):
        self.raw, self.inflate, self.rest = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            data = self.rest or self.raw.read(1 << 16)
            if not data:
                return 0
            out = self.inflate.decompress(data, len(into))
            self.rest = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if out:
                into[: len(out)] = out
                return len(out)


def header_of(lines: Iterator[bytes]) -> dict[str, str]:
    """Fields of a record's header, from the lines after its first one: bytes that are no UTF-8 are replaced, and a line that begins with
    white space goes on with the field before it."""
    header: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            header[name] = f"{header[name]} {text.strip()}".strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        header[name] = value.strip()
    if header.get("warc-payload-digest", "").startswith("sha1:"):
        header["warc-payload-digest"] = header["warc-payload-digest"][5:]
    return header


def length_of(header: dict[str, str]) -> int:
    if not header.get("content-length", "").isdigit():
        raise ValueError(f"a record without a length: {header.get('warc-record-id', 'no id')}")
    return int(header["content-length"])


def records(source: io.BufferedReader, wanted, need_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header fields, payload or None) of the wanted records; blocks of others are stepped over.

    Only responses have a payload here: records of any other type (revisit, resource, conversion, metadata) come with their header alone. A record
    without a length, or with one that is no number, ends the archive: where the next one begins is unknown.
    """
    while True:
        line = source.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:60]!r}")
        header = header_of(iter(lambda: source.readline().rstrip(b"\r\n"), b""))
        length = length_of(header)
        if need_payload and header.get("warc-type") == "response" and wanted(header):
            block = source.read(length)
            if len(block) < length:
                raise ValueError("the archive ends within a record")
            yield header, block.partition(b"\r\n\r\n")[2]
        else:
            _step_over(source, length)
            if wanted(header):
                yield header, None


def gzip_records(raw, wanted, need_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """As records, of gzip members with one record each: only headers and wanted payloads are inflated."""
    source = io.BufferedReader(raw, 1 << 16)
    at = 0
    while head := source.read(HEAD):
        size = member_length(head)
        if not size:  # of another writer
            raw.seek(at)
            yield from records(io.BufferedReader(Members(raw), 1 << 18), wanted, need_payload)
            return
        inflate, text = zlib.decompressobj(31), b""
        while b"\r\n\r\n" not in text and head:
            text += inflate.decompress(head, HEAD)
            head = inflate.unconsumed_tail or source.read(HEAD)
        first, _, rest = text.partition(b"\r\n\r\n")
        lines = iter(first.split(b"\r\n"))
        if not next(lines).startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {first[:60]!r}")
        header = header_of(lines)
        if wanted(header):
            if need_payload and header.get("warc-type") == "response":
                length = length_of(header)
                while len(rest) < length and head and not inflate.eof:
                    rest += inflate.decompress(head)
                    head = source.read(max(HEAD, at + size - source.tell()))
                if len(rest) < length:
                    raise ValueError("the archive ends within a record")
                yield header, rest[:length].partition(b"\r\n\r\n")[2]
            else:
                yield header, None
        at += size
        source.seek(at)


def _step_over(source: io.BufferedReader, length: int) -> None:
    if source.raw.seekable():
        source.seek(length, io.SEEK_CUR)
        return
    while length > 0 and (part := source.read(min(length, 1 << 16))):
        length -= len(part)


def read_archives(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The records below folder, with the given columns of SCHEMA."""
    spark.dataSource.register(WarcSource)
    # Spark asks for this setting wherever a Python source takes filters, and looks at it when the query runs.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = T.StructType([SCHEMA[c] for c in columns]) if columns else SCHEMA
    reader = spark.read.format("warc").schema(schema)
    most = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return reader.option("partitionBytes", most if most else PARTITION_BYTES).load(folder)


def _bytes(size: str) -> int:
    """A Spark size such as 128m or 134217728b in bytes; zero if it is none."""
    number, unit = size.lower().rstrip("b")[:-1], size.lower().rstrip("b")[-1:]
    if unit.isdigit():
        return int(number + unit)
    return int(number) << {"k": 10, "m": 20, "g": 30}[unit] if number.isdigit() and unit in "kmg" else 0


def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each archived page."""
    response = read_archives(spark, folder, ["record_type", "page_id", "payload_bytes", "payload_sha1"]).where("record_type = 'response'")
    response = response.select("page_id", "payload_bytes", "payload_sha1")
    revisit = read_archives(spark, folder, ["record_type", "page_id", "refers_to_page_id", "payload_digest"]).where("record_type = 'revisit'")
    first = materialise(response.select(F.col("page_id").alias("first_id"), "payload_sha1", "payload_bytes").distinct(), "responses")
    seen = revisit.join(first, F.col("refers_to_page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_digest") == F.col("payload_sha1")), "left")
    return response.select(
        F.col("page_id").cast("long"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    ).unionByName(
        seen.select(
            F.col("page_id").cast("long"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("refers_to_page_id").cast("long").alias("refers_to")
        )
    )


ORACLE = r"""
with payloads as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages
), firsts as (
  select *, min(page_id) over (partition by h) as first_id,
    list_reduce(list_transform(string_split(h, ''), lambda d: lpad(bin(('0x' || d)::int), 4, '0')), lambda a, b: a || b) as bits
  from payloads
)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * (bits[5 * k + 1])::int + 8 * (bits[5 * k + 2])::int + 4 * (bits[5 * k + 3])::int + 2 * (bits[5 * k + 4])::int + (bits[5 * k + 5])::int, 1)), '') as payload_digest,
  case when page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from first_id then null else first_id end as refers_to
from firsts
"""
