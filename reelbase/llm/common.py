"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A session without it gets a temporary folder if driver and executors
    are one process; on a cluster, where each machine would write to a disk of its own, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_reelbase_shared", None) or tempfile.mkdtemp(prefix="spark-")
        spark._reelbase_shared = base
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: the lineage ends there,
    and a lost executor costs only what reads the table."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until ``df`` has no such column: a helper column never replaces a user's."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of texts holds. These are settings of the session and hold for what it runs later, too: the operators set them before
    each plan, and none needs larger batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def utf8(column: str) -> Column:
    """A text as bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, most_hot: int = 10_000, frequent: DataFrame | None = None) -> DataFrame:
    """``rows.join(table, key)`` where a key may hold a large part of all rows. ``table`` is a written one with one row per key and ``weight``, how many
    rows have that key. Keys with at least a ``most_hot``-th of the whole weight, of which there are ``most_hot`` at most, are broadcast, so their rows
    stay where they are; the others are shuffled, none of them being large. ``frequent`` lists keys (of a checked number, to
    be broadcast) that many rows have but the table may lack: those rows are left out before anything moves. The weight is left out of the result."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    least = max(1000.0, total / most_hot)
    if frequent is not None:  # of the table's keys, the frequent ones are hot, whatever the table's own weights say
        table = table.join(F.broadcast(frequent.select(key).withColumn("_hot", F.lit(True))), key, "left").withColumn(weight, F.when(F.col("_hot"), float("inf")).otherwise(F.col(weight))).drop("_hot")
    hot = F.broadcast(table.where(F.col(weight) >= least).drop(weight))
    cold = table.where(F.col(weight) < least).drop(weight)
    away = hot.select(key) if frequent is None else hot.select(key).union(frequent.select(key))
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(away), key, "left_anti").join(cold, key))


def parts(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of texts of about ``most`` bytes, so that what is derived from them stays small; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """``make`` runs once in each task and returns what maps its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A dictionary that computes what it lacks; emptied when it holds ``most`` entries, so that
    a task's memory stays bounded."""

    def __init__(self, compute: Callable, most: int = 500_000):
        self.compute, self.most = compute, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.compute(key)
        return out
