"""Folders that driver and executors share, and tables written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a local session without that setting takes a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def written_once(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: what reads it several times computes it once, and a lost executor costs only its own reads."""
    path = fresh_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
