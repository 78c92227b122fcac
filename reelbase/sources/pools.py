"""Pools of photos described by JSON files: one object a file, over many lines, with a list of identities; the files may differ in what they say of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.operators.ranks import ranked
from reelbase.sources.storage import written_once

#: What is read of an entry; a file may lack any of it, or have more.
ENTRY = "name string, slug string, dir string, n_images int, held_out boolean, rank int, category string, quality_photos array<string>"


def scan_pools(spark: SparkSession, paths: list[str], key: str = "celebrities") -> DataFrame:
    """One row for each entry of the files, which come in the order given: ``file``, ``entry`` (places from 0) and the fields of ``ENTRY``. A file that is no such object is an error."""
    out = None
    for number, path in enumerate(paths):
        one = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(_schema(key)).json(path)
        rows = one.select(F.lit(number).alias("file"), F.posexplode(key).alias("entry", "e")).select("file", "entry", "e.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _schema(key: str) -> str:
    fields = ", ".join(f"{n}: {t}" for n, t in (f.split(" ") for f in ENTRY.split(", ")))
    return f"`{key}` array<struct<{fields}>>"


def photos(pool: DataFrame, listing: DataFrame, prefer_quality: bool = True, pattern: str = r"\.jpg$") -> DataFrame:
    """One row for each photo: ``slug``, ``name``, ``rank`` (from 0) and ``path``. An entry has its ``quality_photos``, best first, if it has any and they are asked for, else the
    files of ``listing`` in its folder by name. Entries of one slug follow each other in the order of the pool; an entry without photos adds none. A
    folder, and so a slug, may hold most of all files. Folders are listed once: what is found is written, and ranks and what is made of them read that."""
    quality = F.coalesce(F.col("quality_photos"), F.expr("cast(array() as array<string>)")) if prefer_quality else F.expr("cast(array() as array<string>)")
    entries = pool.withColumn("_quality", quality)
    own = entries.where(F.size("_quality") > 0).select("file", "entry", "slug", "name", F.posexplode("_quality").alias("_at", "path"))
    files = listing.where(~F.col("is_dir") & F.col("name").rlike(pattern)).select("dir", "path")
    listed = entries.where(F.size("_quality") == 0).select("file", "entry", "slug", "name", "dir").join(files, "dir").select("file", "entry", "slug", "name", F.lit(0).alias("_at"), "path")
    found = written_once(own.unionByName(listed), "listed-photos")
    return ranked(found, ["slug"], ["file", "entry", "_at", "path"]).select("slug", "name", "rank", "path")


def with_error(rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    """The rows, or an error if ``bad`` holds for one."""
    kept = F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True)
    return rows.where(kept)


def rectangular(pool_photos: DataFrame, known: list[str]) -> DataFrame:
    """The first n photos of each known slug, n being the smallest number that one of them has, so that a grid over them is full. A known slug without photos is an error; other
    slugs are left out. The ranks are computed once."""
    spark = pool_photos.sparkSession
    wanted = spark.createDataFrame([(k,) for k in sorted(set(known))], "slug string")
    chosen = written_once(pool_photos.join(F.broadcast(wanted), "slug", "left_semi"), "known-photos")
    counts = wanted.join(chosen.groupBy("slug").agg(F.count(F.lit(1)).alias("n")), "slug", "left")
    counts = with_error(counts, F.col("n").isNull(), F.concat(F.lit("no photos found for "), F.col("slug")))
    least = counts.agg(F.min("n").alias("_least"))  # one row
    return chosen.crossJoin(F.broadcast(least)).where(F.col("rank") < F.col("_least")).drop("_least")


def usable(pool_photos: DataFrame, least: int = 3) -> DataFrame:
    """The photos, or an error if fewer than ``least`` slugs have any. The ranks are computed once."""
    pool_photos = written_once(pool_photos, "ranked-photos")
    slugs = pool_photos.select("slug").distinct().agg(F.count(F.lit(1)).alias("_slugs"))  # one row
    return with_error(pool_photos.crossJoin(F.broadcast(slugs)), F.col("_slugs") < least, F.concat(F.lit("too few usable identities: "), F.col("_slugs").cast("string"))).drop("_slugs")
