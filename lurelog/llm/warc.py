"""WARC archives as a PySpark data source.

Records are gzip members, each with its compressed length in the member's
header, so that a reader passes over a record it does not want without
inflating it.  A response record carries an HTTP response whose body is the
payload; a revisit record carries the HTTP header alone and names the response
with the same payload.

Reading plans partitions from whole files, several small ones together.
Equality and membership predicates on record type, identifier, target, refers
and digest are pushed down: the reader inflates and parses a record's header
first and leaves the payload alone unless the record passes and payloads are
asked for (option ``payload``, ``true`` by default).

Writing puts each task's records into files of bounded size under
``_attempts``; the commit moves those of successful attempts into place, so a
lost executor or a second attempt leaves no record twice.

Defined cases
    null payload       the empty payload
    null identifier    written with an identifier of its own, read back as null page
    very long payloads one record, whatever the file size
    repeated rows      rows equal in page, address and payload are one capture and share its record type
    empty table        no record; reading gives no rows
    clashing columns   only page_id, url and html are read
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from lurelog.staging import new_path, staged

SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary"
)
#: Header field of each column that predicates may name.
FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file after which the next one begins, and of the files of one read partition.
FILE_BYTES = 64 << 20
PARTITION_BYTES = 16 << 20
#: Records in an Arrow batch, and bytes of inflated text looked at for a header.
BATCH = 256
HEADER_BYTES = 4096
_LENGTHS = struct.Struct("<2sHII")


# One record ---------------------------------------------------------------------------------

def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field holds its compressed and inflated length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = 10 + 2 + _LENGTHS.size
    extra = _LENGTHS.pack(b"sl", 8, head + len(body) + 8, len(data))
    fixed = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x04\xff"
    return b"".join([fixed, struct.pack("<H", len(extra)), extra, body, struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)])


def record(row: dict, date: str) -> bytes:
    """The text of one WARC record."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date),
        ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
    ]
    if revisit:
        fields += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"])


def parse_fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is not one."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def columns_of(fields: dict[str, str]) -> dict:
    """The columns that a record's header gives."""
    found = {column: fields.get(name.lower()) for column, name in FIELDS.items()}
    for column in ("record_id", "refers_to"):
        if found[column]:
            found[column] = found[column].strip("<>")
    if found["payload_digest"]:
        found["payload_digest"] = found["payload_digest"].removeprefix("sha1:")
    return found


def members(stream) -> Iterator[bytes]:
    """Each gzip member of a file; one that tells its length is not inflated."""
    while head := stream.read(12):
        extra = stream.read(struct.unpack("<H", head[10:12])[0]) if head[3] & 4 else b""
        if len(extra) == _LENGTHS.size and extra[:2] == b"sl":
            _, _, packed, _ = _LENGTHS.unpack(extra)
            yield head + extra + stream.read(packed - 12 - len(extra))
        else:
            # A member of another writer: its end shows only by inflating.
            data, unpacker = head + extra, zlib.decompressobj(31)
            unpacker.decompress(data)
            while not unpacker.eof and (more := stream.read(1 << 16)):
                unpacker.decompress(more)
                data += more
            spare = len(unpacker.unused_data)
            if spare:
                stream.seek(stream.tell() - spare)
                data = data[:-spare]
            yield data


# Reading ------------------------------------------------------------------------------------

@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(self.paths)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in FIELDS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[Files]:
        system, base = opened(self.path)
        found = [x for x in system.get_file_info(pafs.FileSelector(base)) if x.is_file and x.base_name.endswith(".warc.gz")]
        groups, size = [], PARTITION_BYTES
        for x in sorted(found, key=lambda x: x.path):
            if size + x.size > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += x.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        schema = pa.schema([
            *[(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")],
            ("payload_bytes", pa.int64()), ("payload", pa.binary()),
        ])
        rows = []
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                for packed in members(stream):
                    row = self.row(packed)
                    if row is not None:
                        rows.append(row)
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def row(self, packed: bytes) -> dict | None:
        """The columns of one member, or None if it is not wanted; the payload is inflated last."""
        unpacker = zlib.decompressobj(31)
        data = unpacker.decompress(packed, HEADER_BYTES)
        while b"\r\n\r\n" not in data and (more := unpacker.decompress(unpacker.unconsumed_tail, HEADER_BYTES)):
            data += more
        head, _, block = data.partition(b"\r\n\r\n")
        fields = parse_fields(head)
        row = columns_of(fields)
        if any(row[name] not in values for name, values in self.wanted.items()):
            return None
        length = int(fields.get("content-length", 0))
        while (b"\r\n\r\n" not in block or self.payload and len(block) < length) and unpacker.unconsumed_tail:
            limit = max(HEADER_BYTES, length - len(block)) if self.payload else HEADER_BYTES
            block += unpacker.decompress(unpacker.unconsumed_tail, limit)
        http, _, body = block.partition(b"\r\n\r\n")
        row["payload_bytes"] = int(parse_fields(http).get("content-length", 0))
        if self.payload and row["record_type"] == "response":
            row["payload"] = body[: length - len(http) - 4]
        return row


# Writing ------------------------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = opened(self.path)
        system.create_dir(f"{base}/_attempts", recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size > FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"part-{task.partitionId():06d}-{len(names):04d}-{task.taskAttemptId()}.warc.gz")
                        out, size = system.open_output_stream(f"{base}/_attempts/{names[-1]}", compression=None), 0
                    packed = member(record(row, self.date))
                    out.write(packed)
                    size += len(packed)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = opened(self.path)
        system.create_dir(base, recursive=True)
        for message in messages:
            for name in message.names if message else []:
                system.move(f"{base}/_attempts/{name}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = opened(self.path)
        if system.get_file_info(f"{base}/_attempts").type != pafs.FileType.NotFound:
            system.delete_dir(f"{base}/_attempts")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# Pages to records ---------------------------------------------------------------------------

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32: 160 bits are 32 digits without padding."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    digits = [F.shiftright(g, s).bitwiseAND(F.lit(31)) for g in groups for s in (15, 10, 5, 0)]
    return F.concat(*[F.substring(F.lit(ALPHABET), d + 1, F.lit(1)) for d in digits])


def capture_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows for the writer: of equal payloads of ``min_bytes`` or more the smallest page is the response.

    Only digests meet in the grouping; a digest with one page needs no partner.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    read = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    digested = read.withColumn("payload_digest", base32_sha1(F.col("payload")))
    capture = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("page"), F.coalesce("url", F.lit("")).alias("url"))
    first = digested.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(
        F.min(capture).alias("first"), F.count("*").alias("n")
    )
    shared = staged(first.where("n > 1").select("payload_digest", "first"), "warc-shared")
    joined = digested.join(shared, "payload_digest", "left").withColumn("own", capture)
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & (F.col("first") != F.col("own"))
    named = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none-"), F.col("payload_digest"))))
    origin = F.concat(
        F.lit("urn:page:"),
        F.when(F.col("first.page") == (1 << 63) - 1, F.concat(F.lit("none-"), F.col("payload_digest"))).otherwise(F.col("first.page").cast("string")),
    )
    return joined.select(
        named.alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, origin).alias("refers_to"),
        "payload_digest", "payload_bytes",
        F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
    )


def _page(record_id: Column) -> Column:
    return F.regexp_replace(record_id, "^urn:page:", "").try_cast("bigint")


def captured(spark: SparkSession, path: str) -> DataFrame:
    """One row a page from the archives: response payloads are measured, revisits read by their headers."""
    archive = spark.read.format("warc")
    responses = archive.option("payload", "true").load(path).where(F.col("record_type") == "response")
    revisits = archive.option("payload", "false").load(path).where(F.col("record_type") == "revisit")
    measured = responses.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload")
    return measured.union(revisits.drop("payload")).select(
        _page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page(F.col("refers_to")).alias("refers_to")
    )


def op8_warc(spark, sf_dir: str) -> DataFrame:
    register(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_path(spark, "warc")
    capture_records(pages).write.format("warc").mode("append").save(path)
    return captured(spark, path)


OP8_SQL = r"""
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), groups AS (
  SELECT *, [('0x' || substr(hex, 5 * g + 1, 5))::BIGINT FOR g IN range(8)] AS twenty FROM digests
), coded AS (
  SELECT page_id, payload_bytes, array_to_string(
    [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
     || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)
     FOR v IN twenty], '') AS payload_digest
  FROM groups
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_page FROM coded GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM coded JOIN firsts USING (payload_digest)
"""
