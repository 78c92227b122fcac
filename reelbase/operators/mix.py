"""Selecting, mixing and sampling episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.functions.names import stable_hash
from reelbase.operators.ranks import ranked
from reelbase.sources.storage import written_once


def parsed_filter(spark: SparkSession, text: str) -> DataFrame:
    """(repo, episode) of "repo:0,1;repo2:3"; malformed parts are skipped."""
    parts = spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", ";")).alias("p"))
    return parts.where(F.col("p").contains(":")).select(F.trim(F.split_part("p", F.lit(":"), F.lit(1))).alias("repo"), F.explode(F.split(F.split_part("p", F.lit(":"), F.lit(2)), ",")).alias("e")).select("repo", F.expr("try_cast(trim(e) AS bigint)").alias("episode")).where("episode IS NOT NULL AND repo <> ''")


def kept_episodes(df: DataFrame, keep: DataFrame | None = None, drop: DataFrame | None = None, on=("repo_no", "episode_index")) -> DataFrame:
    """Only the listed episodes, else all but the excluded ones, else all."""
    if keep is not None:
        return df.join(keep, list(on), "left_semi")
    return df.join(drop, list(on), "left_anti") if drop is not None else df


def replicated(df: DataFrame, weight: str) -> DataFrame:
    """Each row ``weight`` times, with ``copy`` from 0 on; weights below 1 drop the row."""
    return df.where(F.col(weight) >= 1).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(weight).cast("int") - 1)))


def seeded_pick(df: DataFrame, group: list[str], key: str, seed: int, tag: str, k: int) -> DataFrame:
    """k rows of each group in the order of md5(seed:tag:key): the same rows for the same seed, however the data is dealt."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), F.col(key).cast("string")))
    ranked = df.withColumn("_o", order)
    from pyspark.sql import Window

    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_o", key))).where(F.col("_r") <= k).drop("_o", "_r")


def episode_split(df: DataFrame, share: float, seed: int, keys=("repo_no", "episode_index")) -> DataFrame:
    """Adds ``split`` (train or validation), decided by episode and never by frame."""
    return df.withColumn("split", F.when(stable_hash(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])) / F.lit(4294967295.0) < share, "validation").otherwise("train"))


def interior_frames(lengths: DataFrame, k: int, length: str = "length") -> DataFrame:
    """k evenly spaced inner frames int(n * i / (k + 1)) of each episode, each once."""
    return lengths.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("frame_index", F.floor(F.col(length) * F.col("i") / (k + 1))).drop("i").distinct()


def even_shards(df: DataFrame, order: str, shards: int) -> DataFrame:
    """Adds ``shard``: an even split in the order given, the first shards one larger, as an ntile over the whole table gives it. Rows get their places by ranges (:func:`ranked`), whose
    bounds a row meets by halving, so a row costs a few comparisons and no task sees all rows."""
    stored = written_once(df, "even-shards")
    total = stored.agg(F.count(F.lit(1)).alias("_all"))  # one row
    placed = ranked(stored, [], [order], "_r").crossJoin(F.broadcast(total))
    size, more = F.expr(f"_all div {shards}"), F.expr(f"_all % {shards}")
    wide = more * (size + 1)
    shard = F.when(F.col("_r") < wide, F.floor(F.col("_r") / (size + 1))).otherwise(more + F.floor((F.col("_r") - wide) / F.greatest(size, F.lit(1))))
    return placed.withColumn("shard", shard.cast("int")).select(*df.columns, "shard")
