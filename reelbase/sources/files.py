"""Folders as tables: a listing source that opens no file, an image source that reads headers only, and a writer of one file per row.

Both sources are planned by folder: the driver lists folders down to a given depth, never their files, and each task lists the folders it was given. A folder of very many files
is dealt to several tasks by a hash of the file names. Paths may be of any store that Arrow's file systems open.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

LISTING = "path string, dir string, name string, bytes long, modified timestamp, is_dir boolean"
HEADERS = "path string, dir string, name string, bytes long, format string, width int, height int, header_bytes int"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    fs, root = pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)
    return fs, root.rstrip("/")


def listed(fs: pafs.FileSystem, folder: str, recursive: bool = False) -> list[pafs.FileInfo]:
    """What a folder holds, sorted; nothing if it does not exist."""
    return sorted(fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=recursive)), key=lambda f: f.path)


# ---- sources


@dataclass
class Folders(InputPartition):
    """Folders of one task: (path, whether with all below it); of their files those whose name hash has this remainder."""

    folders: list[tuple[str, bool]]
    share: int
    shares: int


class FolderReader(DataSourceReader):
    """Options: ``path``; ``depth`` (folders at this depth are dealt to tasks, 1 unless given); ``recursive`` (whether what lies deeper is listed too, true unless given); ``shares`` (tasks for each group of folders, 1 unless
    given); ``tasks`` (at most so many groups of folders, 1000 unless given)."""

    def __init__(self, schema: StructType, options):
        self.path = options.get("path") or ""
        if not self.path:
            raise ValueError("the option path is missing")
        self.below = options.get("recursive", "true").lower() == "true"
        self.depth, self.shares, self.tasks = (int(options.get(k, v)) for k, v in (("depth", "1"), ("shares", "1"), ("tasks", "1000")))

    def partitions(self):
        fs, root = open_fs(self.path)
        level, folders = [root], []
        for _ in range(self.depth):
            folders += [(f, False) for f in level]
            level = [f.path for folder in level for f in listed(fs, folder) if f.type == pafs.FileType.Directory]
        folders += [(f, self.below) for f in level]
        groups = min(len(folders), self.tasks)
        return [Folders(folders[g::groups], s, self.shares) for g in range(groups) for s in range(self.shares)]

    def entries(self, part: Folders) -> Iterator[tuple[pafs.FileSystem, str, pafs.FileInfo]]:
        """File system, path below the root and info of what a task is responsible for."""
        fs, root = open_fs(self.path)
        for folder, below in part.folders:
            for f in listed(fs, folder, below):
                if crc32(f.path.encode()) % part.shares == part.share:
                    yield fs, f.path[len(root) + 1 :], f

    def read(self, partition):
        rows = []
        for row in self.rows(partition):
            rows.append(row)
            if len(rows) == 5000:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)


class ListingReader(FolderReader):
    def rows(self, partition):
        for _, path, f in self.entries(partition):
            folder = f.type == pafs.FileType.Directory
            yield path, path.rpartition("/")[0], f.base_name, None if folder else f.size, f.mtime, folder

    def batch(self, rows):
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "dir", "name", "bytes", "modified", "is_dir"])


class ListingSource(DataSource):
    """``spark.read.format("reel_files")``: one row for each file and folder below ``path``, without opening any."""

    @classmethod
    def name(cls):
        return "reel_files"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return ListingReader(schema, self.options)


class HeaderReader(FolderReader):
    """More options: ``pattern`` (of file names), ``most`` (bytes read of one file at most, 65536 unless given), ``unreadable`` ("skip", or "keep" for a row without sizes)."""

    def __init__(self, schema: StructType, options):
        super().__init__(schema, options)
        self.pattern, self.most, self.keep = options.get("pattern", r"(?i)\.(jpe?g|png|gif|bmp|webp)$"), int(options.get("most", 1 << 16)), options.get("unreadable", "skip") == "keep"

    def rows(self, partition):
        wanted = re.compile(self.pattern)
        for fs, path, f in self.entries(partition):
            if f.type != pafs.FileType.File or not wanted.search(f.base_name):
                continue
            with fs.open_input_file(f.path) as source:
                start = Start(lambda at, n, source=source: source.read_at(n, at), self.most)
                got = image_size(start)
            if got or self.keep:
                yield path, path.rpartition("/")[0], f.base_name, f.size, *(got or (None, None, None)), start.read

    def batch(self, rows):
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "dir", "name", "bytes", "format", "width", "height", "header_bytes"])


class HeaderSource(DataSource):
    """``spark.read.format("reel_images")``: format, width and height of each image below ``path``, from its first bytes."""

    @classmethod
    def name(cls):
        return "reel_images"

    def schema(self):
        return HEADERS

    def reader(self, schema):
        return HeaderReader(schema, self.options)


def register(spark: SparkSession) -> None:
    for source in (ListingSource, HeaderSource):
        spark.dataSource.register(source)


def listing(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("reel_files").options(path=path, **options).load()


def image_headers(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("reel_images").options(path=path, **options).load()


# ---- image headers


class Start:
    """Ranged reads of a file that count their bytes; beyond ``most`` nothing is read."""

    def __init__(self, at: Callable[[int, int], bytes], most: int):
        self.at, self.most, self.read = at, most, 0

    def bytes(self, place: int, n: int) -> bytes:
        n = min(n, self.most - self.read)
        got = self.at(place, n) if n > 0 else b""
        self.read += len(got)
        return got


def image_size(start: Start) -> tuple[str, int, int] | None:
    """(format, width, height) of PNG, GIF, BMP, WebP and JPEG; None if the header is none of these, is cut off, or gives no size."""
    head = start.bytes(0, 30)
    big, little = (lambda lo, n: int.from_bytes(head[lo : lo + n], "big")), (lambda lo, n: int.from_bytes(head[lo : lo + n], "little"))
    found = None
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        found = "png", big(16, 4), big(20, 4)
    elif head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        found = "gif", little(6, 2), little(8, 2)
    elif head[:2] == b"BM" and len(head) >= 26:
        old = little(14, 4) == 12
        found = ("bmp", little(18, 2), little(20, 2)) if old else ("bmp", little(18, 4), abs(int.from_bytes(head[22:26], "little", signed=True)))
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        kind = head[12:16]
        if kind == b"VP8 ":
            found = "webp", little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
        elif kind == b"VP8L":
            bits = little(21, 4)
            found = "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        elif kind == b"VP8X":
            found = "webp", little(24, 3) + 1, little(27, 3) + 1
    elif head[:2] == b"\xff\xd8":
        found = jpeg_size(start)
    return found if found and found[1] > 0 and found[2] > 0 else None


def jpeg_size(start: Start) -> tuple[str, int, int] | None:
    """Goes from marker to marker, over the segments, to the frame header."""
    place = 2
    while True:
        head = start.bytes(place, 9)
        if len(head) < 4 or head[0] != 0xFF:
            return None
        kind = head[1]
        if kind == 0xFF:  # fill byte
            place += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # no segment follows
            place += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return ("jpeg", int.from_bytes(head[7:9], "big"), int.from_bytes(head[5:7], "big")) if len(head) == 9 else None
        elif kind in (0xD9, 0xDA):  # the end, or picture data, before any frame header
            return None
        else:
            place += 2 + int.from_bytes(head[2:4], "big")


# ---- writing

FILES = 5_000  # files that one task writes: making a file costs more than reading its row, so the bytes of a table say little of the tasks that its files need


def dealt(rows: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """The rows in as many tasks as their number asks for, by a hash of ``keys``, which are all but unique. Rows of few bytes come in one task however many they are. They are counted first, so they are read
    twice; deal them before a large content is made, then only what it is made of moves."""
    return rows.repartition(max(1, -(-rows.count() // (each or FILES))), *keys)


def write_files(rows: DataFrame, root: str) -> int:
    """(path, content) -> one file for each row below ``root``, in the task that has the row (see :func:`dealt`); how many were written. A null content is an empty file, a null path none. A file appears
    whole, under its own name once it is written, so a task that runs again, after a lost executor, only puts the same file there once more. A path
    that leads out of ``root`` is an error."""

    def run(batches):
        fs, base = open_fs(root)
        made = set()
        for batch in batches:
            written = 0
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path = path.as_py()
                if path is None:
                    continue
                if path.startswith("/") or not path or {"", ".", ".."} & set(path.split("/")):
                    raise ValueError(f"no path of a file below the root: {path!r}")
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                content = content.as_buffer() or b""
                first = f"{folder}/.{uuid.uuid4().hex}" if content else f"{base}/{path}"  # an empty file is whole once it is there
                with fs.open_output_stream(first) as out:
                    out.write(content)
                if content:
                    fs.move(first, f"{base}/{path}")
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    chosen = rows.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    return chosen.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def checkpoints(spark: SparkSession, root: str, payload: str = "pretrained_model", wanted: list[int] | None = None) -> DataFrame:
    """(step, path): the folders below ``root`` whose name is a number and that hold ``payload``, a file or a folder. With ``wanted``, these steps
    only, and a missing one is an error."""
    own = F.regexp_extract("path", f"^([0-9]+)/{re.escape(payload)}(/|$)", 1)
    found = listing(spark, root).select(own.alias("step_name")).where("step_name <> ''").distinct()
    found = found.select(F.col("step_name").cast("long").alias("step"), F.concat_ws("/", "step_name", F.lit(payload)).alias("path"))
    if wanted is None:
        return found
    asked = spark.createDataFrame([(x,) for x in sorted(set(wanted))], "step long")
    missing = F.raise_error(F.concat(F.lit("no checkpoint of step "), F.col("step").cast("string"))).cast("string")
    return asked.join(found, "step", "left").select("step", F.coalesce("path", missing).alias("path"))
