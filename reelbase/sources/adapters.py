"""Views over the given tables in the shape of episode datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOINTS = ("pan", "lift", "elbow", "wrist_flex", "wrist_roll", "gripper")
FPS = 30

#: The frames view as SQL for the oracle.
FRAMES_SQL = """frames AS (
  SELECT user_id AS episode_index, user_id % 9 AS repo_no,
         row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS frame_index, event_id,
         CAST((event_id * 37) % 181 AS DOUBLE) - 90 AS pan, CAST((event_id * 53) % 121 AS DOUBLE) - 110 AS lift,
         CAST((event_id * 17) % 101 AS DOUBLE) AS elbow, CAST((event_id * 29) % 91 AS DOUBLE) - 100 AS wrist_flex,
         CAST((event_id * 41) % 181 AS DOUBLE) - 90 AS wrist_roll, least(value, 60.0) AS gripper
  FROM events)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(events: DataFrame) -> DataFrame:
    """One row per frame: repo_no, episode_index, frame_index, event_id and the six joints. One shuffle, on the episode and its repo, which later windows
    and groups of episodes reuse."""
    joint = lambda k, m, off: ((F.col("event_id") * k) % m).cast("double") - off
    keyed = events.select(F.col("user_id").alias("episode_index"), (F.col("user_id") % 9).alias("repo_no"), "event_id", "ts", "value")
    return keyed.select(
        "episode_index",
        "repo_no",
        (F.expr("row_number() OVER (PARTITION BY repo_no, episode_index ORDER BY ts)") - 1).cast("long").alias("frame_index"),
        "event_id",
        joint(37, 181, 90).alias("pan"),
        joint(53, 121, 110).alias("lift"),
        joint(17, 101, 0).alias("elbow"),
        joint(29, 91, 100).alias("wrist_flex"),
        joint(41, 181, 90).alias("wrist_roll"),
        F.least("value", F.lit(60.0)).alias("gripper"),
    )


def frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(read(spark, sf_dir, "events"))


def repo_names(df: DataFrame, repo: str = "repo_no") -> DataFrame:
    """Adds ``repo_id``: dataset_v2_<identity>_<position>_1."""
    return df.withColumn("repo_id", F.expr(f"concat('dataset_v2_', element_at(array('person_a', 'person_b', 'person_c'), cast({repo} div 3 as int) + 1), '_', element_at(array('left', 'middle', 'right'), cast({repo} % 3 as int) + 1), '_1')"))
