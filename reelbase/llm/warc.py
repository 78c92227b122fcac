"""WARC archives as a PySpark data source.

Reading plans one partition per stretch of archive files, takes record-type and header predicates, and goes through each
file record by record, headers first. Archives may be plain or gzip, with one or more records per gzip member. In archives that this module wrote, a record that
the predicates reject, or of which no payload is asked, is passed over by the stored length of its gzip member, without inflating its payload; in others it is
inflated and dropped, or, in plain files, sought over. Gzip files longer than a stretch are split: a range begins with the first member found in it that
holds a record; plain files are not split. Writing gives each task its own file; files appear under their final names when the job commits.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from reelbase.llm.common import cut, fresh_path, lookup, small_batches

SCHEMA = "record_id string, date string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary"
#: Which header each column is read from.
HEADERS = {"record_id": "WARC-Record-ID", "date": "WARC-Date", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def clean(value) -> str:
    """A header's value stays on its line."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def member(headers: dict, payload: bytes, level: int = 1) -> bytes:
    """One record as a gzip member. Its extra field "sl" holds the member's and the record's lengths, so that a reader can pass over it."""
    body = HEAD if headers["WARC-Type"] == "revisit" else HEAD + payload
    lines = "".join(f"{k}: {clean(v)}\r\n" for k, v in headers.items() if v is not None)
    record = f"WARC/1.1\r\n{lines}Content-Type: application/http;msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = z.compress(record) + z.flush()
    extra = b"sl" + struct.pack("<HQQ", 16, len(packed), len(record))
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


NAMES = {n.lower(): n for n in (*HEADERS.values(), "Content-Length", "Content-Type")}


def parsed(block: bytes) -> dict[str, str]:
    """Headers of a block: names as this module writes them whatever their case, values trimmed, continued lines joined."""
    lines: list[str] = []
    for line in block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        elif line:
            lines.append(line)
    pairs = (line.partition(":") for line in lines)
    return {NAMES.get(k.strip().lower(), k.strip()): v.strip() for k, _, v in pairs}


class Bytes:
    """What a plain or gzip archive holds, read forward. Between two gzip members nothing is buffered, so the file stands at the next one."""

    def __init__(self, f: BinaryIO, packed: bool):
        self.f, self.packed, self.z, self.pending, self.buffer = f, packed, None, b"", b""

    def at_member(self) -> bool:
        return self.packed and self.z is None and not self.buffer

    def fill(self) -> bool:
        if not self.packed:
            more = self.f.read(1 << 16)
            self.buffer += more
            return bool(more)
        data = self.pending or self.f.read(1 << 16)
        if not data:
            return False
        if self.z is None:
            self.z = zlib.decompressobj(31)
        self.buffer += self.z.decompress(data, 1 << 20)
        self.pending = self.z.unconsumed_tail
        if self.z.eof:
            self.f.seek(-len(self.z.unused_data), 1)
            self.z, self.pending = None, b""
        return True

    def until_blank(self) -> bytes | None:
        """Up to the next blank line; None at the end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                if self.buffer.strip():
                    raise ValueError("a record ends in its headers")
                return None
        block, self.buffer = self.buffer[:at], self.buffer[at + 4 :]
        return block

    def take(self, n: int, keep: bool) -> bytes:
        """The next n bytes, or nothing of them if they are not to be kept."""
        parts = []
        if not self.packed and not keep and n > len(self.buffer):
            self.f.seek(n - len(self.buffer), 1)
            self.buffer = b""
            return b""
        while n:
            if not self.buffer and not self.fill():
                raise ValueError("a record ends early")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)

    def skip_ends(self) -> None:
        """Passes over the line ends after a record, and with them to the end of its member."""
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            if self.buffer or (self.packed and self.z is None) or not self.fill():
                return


def body_of(headers: dict, body: bytes) -> bytes:
    """The payload: what follows the HTTP headers, or the whole block of a record without them."""
    return body.partition(b"\r\n\r\n")[2] if headers.get("Content-Type", "").startswith("application/http") else body


def member_from(f: BinaryIO, start: int, size: int) -> int:
    """The first place from ``start`` on at which a gzip member begins that holds a record; the file's size without one."""
    at, window = start, 1 << 20
    while at < size:
        f.seek(at)
        block = f.read(window + 4096)
        found = -1
        while (found := block.find(b"\x1f\x8b\x08", found + 1)) >= 0 and found < window:
            try:
                if zlib.decompressobj(31).decompress(block[found : found + 4096], 5) == b"WARC/":
                    return at + found
            except zlib.error:
                pass
        at += window
    return size


def records(f: BinaryIO, wants=lambda headers: True, payload: bool = True, start: int = 0, end: int | None = None) -> Iterator[tuple[dict, bytes | None]]:
    """Headers and payload of the wanted records of an archive whose member begins at ``start`` or later and before ``end``. Without ``payload`` no payload is
    kept. A revisit has none."""
    f.seek(0)
    packed = f.read(2) == b"\x1f\x8b"
    if packed and start:
        f.seek(0, 2)
        start = member_from(f, start, f.tell())
    f.seek(start)
    source = Bytes(f, packed)
    while True:
        if source.at_member():
            here = f.tell()
            if end is not None and here >= end:
                return
            first = f.read(12)
            if first[:4] == b"\x1f\x8b\x08\x04":
                extra = f.read(struct.unpack("<H", first[10:12])[0])
                if extra[:2] == b"sl":
                    yield from stored(f, struct.unpack("<QQ", extra[4:20])[0], wants, payload)
                    continue
            f.seek(here)
        block = source.until_blank()
        if block is None:
            return
        headers = parsed(block.lstrip(b"\r\n"))
        wanted = wants(headers)
        keep = wanted and payload and headers.get("WARC-Type") != "revisit"
        body = source.take(int(headers.get("Content-Length", 0)), keep)
        source.skip_ends()
        if wanted:
            yield headers, body_of(headers, body) if keep else None


def stored(f: BinaryIO, packed: int, wants, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """The record of a member with a stored length, if it is wanted; its payload is inflated only if asked for."""
    first = f.read(min(packed, 1024))
    z = zlib.decompressobj(-15)
    head = z.decompress(first, 1 << 16)
    read = len(first)
    while b"\r\n\r\n" not in head and not z.eof:
        tail = z.unconsumed_tail
        more = b"" if tail else f.read(min(packed - read, 4096))
        read += len(more)
        got = z.decompress(tail + more, 1 << 16)
        if not (got or tail or more):
            raise ValueError("a record ends in its headers")
        head += got
    block, _, rest = head.partition(b"\r\n\r\n")
    headers = parsed(block)
    if not wants(headers):
        f.seek(packed - read + 8, 1)
    elif not payload or headers["WARC-Type"] == "revisit":
        f.seek(packed - read + 8, 1)
        yield headers, None
    else:
        rest += z.decompress(z.unconsumed_tail + f.read(packed - read)) + z.flush()
        f.seek(8, 1)
        yield headers, body_of(headers, rest[: int(headers["Content-Length"])])


@dataclass
class Ranges(InputPartition):
    """(path, from, to) of stretches of files."""

    parts: list[tuple[str, int, int]]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.names, self.path, self.equal = schema.fieldNames(), options["path"], {}
        self.payload = options.get("payload", "true") == "true"
        self.stretch = int(options.get("stretchBytes", 32 << 20))

    def pushFilters(self, filters):
        """Equality and IN on a header's column are tested on the headers; Spark tests the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.attribute[0] != "payload_length":
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[f.attribute[0]] = self.equal.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self):
        fs, path = open_fs(self.path)
        ends = (".warc.gz", ".warc")
        files = sorted((i for i in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if i.is_file and i.base_name.endswith(ends) and not i.base_name.startswith("_")), key=lambda i: i.path)
        out, size = [], 0
        for i in files:
            step = self.stretch if i.base_name.endswith(".gz") else max(i.size, 1)
            for start in range(0, i.size, step):
                part = min(step, i.size - start)
                if not out or size + part > self.stretch:
                    out.append(Ranges([]))
                    size = 0
                out[-1].parts.append((i.path, start, start + part))
                size += part
        return out or [Ranges([])]

    def read(self, partition):
        fs, _ = open_fs(self.path)
        tests = [(HEADERS[c], values) for c, values in self.equal.items()]
        wants = lambda h: all(h.get(k) in v for k, v in tests)
        rows, size = [], 0
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n == "payload_length" else pa.string()) for n in self.names])
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        for path, start, end in partition.parts:
            with fs.open_input_file(path) as f:
                for h, payload in records(f, wants, self.payload and "payload" in self.names, start, end):
                    rows.append([payload if n == "payload" else (int(h[HEADERS[n]]) if n == "payload_length" and HEADERS[n] in h else h.get(HEADERS[n])) for n in self.names])
                    size += len(payload or b"") + 200
                    if size > 8 << 20:
                        yield pack()
                        rows, size = [], 0
        if rows:
            yield pack()


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    count: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options, overwrite: bool):
        self.names, self.path, self.overwrite = schema.fieldNames(), options["path"], overwrite

    def write(self, iterator):
        fs, path = open_fs(self.path)
        fs.create_dir(path, recursive=True)
        name, count, now = uuid.uuid4().hex, 0, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        temporary, final = f"{path}/_{name}.part", f"{path}/{name}.warc.gz"
        with fs.open_output_stream(temporary) as f:
            for b in iterator:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    r = dict(zip(self.names, row, strict=True))
                    headers = {HEADERS[c]: r.get(c) for c in HEADERS}
                    headers["WARC-Date"] = r.get("date") or now
                    if r["record_type"] == "revisit":
                        headers["WARC-Profile"] = REVISIT_PROFILE
                    f.write(member(headers, r.get("payload") or b""))
                    count += 1
        return Written(temporary, final, count)

    def commit(self, messages):
        fs, path = open_fs(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(path)):
                if i.is_file and i.base_name.endswith(".warc.gz"):
                    fs.delete_file(i.path)
        for m in messages:
            if m and m.count:
                fs.move(m.temporary, m.final)
            elif m:
                fs.delete_file(m.temporary)

    def abort(self, messages):
        fs, _ = open_fs(self.path)
        for m in messages:
            if m:
                fs.delete_file(m.temporary)


class WarcDataSource(DataSource):
    """Format "warc". Options: path; payload ("false": leave payloads unread); stretchBytes (bytes of files per partition)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(schema, self.options, overwrite)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digests(df: DataFrame, id_col: str, payload: F.Column, id_type: str, extra: str = "") -> DataFrame:
    """id, digest and length of binary payloads; no payload leaves its task."""

    def run(batches):
        for b in batches:
            p = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest_of(x) for x in p]), pa.array([len(x) for x in p], pa.int64())], ["id", "digest", "bytes"])

    return df.select(F.col(id_col).alias("id"), payload.alias("payload")).mapInArrow(run, f"id {id_type}, digest string, bytes long")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record per row. Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the largest id is a response, the others
    revisit it without a payload; smaller payloads are all responses. Null payloads are empty, null urls have no target header; rows of one id with other
    payloads are records of their own, a repeated row is written each time. A row without an id never is the one revisited; if all rows of a payload have none,
    they are responses."""
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keys = cut(chosen.where(F.octet_length("payload") >= least_bytes).select("id", "digest"), "digests")
    # digests that several rows share; the rest needs no join at all
    shared = keys.groupBy("digest").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("rows")).where("rows > 1 AND kept IS NOT NULL")
    revisits = lookup(keys, cut(shared, "shared"), "digest", "rows").where("id IS NULL OR id <> kept").select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "kept").distinct()
    typed = chosen.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        for b in batches:
            p = b.column("payload").to_pylist()
            kept = b.column("kept").to_pylist()
            columns = {
                "record_id": pa.array([f"<urn:page:{'' if i is None else i}>" for i in b.column("id").to_pylist()]),
                "date": pa.array([now] * len(p)),
                "record_type": pa.array(["response" if k is None else "revisit" for k in kept]),
                "target_uri": b.column("url"),
                "payload_digest": pa.array([f"sha1:{base64.b32encode(bytes.fromhex(x)).decode()}" for x in b.column("digest").to_pylist()]),
                "payload_length": pa.array([len(x) for x in p], pa.int64()),
                "refers_to": pa.array([None if k is None else f"<urn:page:{k}>" for k in kept], pa.string()),
                "payload": pa.array([x if k is None else None for x, k in zip(p, kept, strict=True)], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    typed.select("id", "url", "payload", "digest", "kept").mapInArrow(run, SCHEMA).write.format("warc").mode("append").save(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of an archive. Responses are read with their payload, from which length and
    digest are computed anew; revisits, which the type predicate picks by their headers, without."""
    register(spark)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    responses = spark.read.format("warc").load(path).where("record_type = 'response'")
    seen = digests(responses, "record_id", F.coalesce("payload", F.lit(b"")), "string").select(number("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'revisit'")
    return seen.unionByName(revisits.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.expr("substring(payload_digest, 6)").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive the pages in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    archive(pages, path, least_bytes)
    return read_back(pages.sparkSession, path)
