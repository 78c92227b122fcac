"""Episode datasets as folders: frames, episodes with statistics, tasks, info and global statistics; writing, reading and checking them.

    data/repo_id=<repo>/*.parquet        frames in the storage types
    meta/episodes/repo_id=<repo>/        one row per episode
    meta/tasks/                          repo_id, task_index, task
    meta/info/                           JSON, one line per repo
    meta/stats/                          JSON, one line per repo: {feature: {statistic: [value of each dimension]}}
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelbase.operators.stats import dimension_stats, large_stats
from reelbase.operators.timeseries import renumbered
from reelbase.sources.adapters import FPS, JOINTS, repo_names
from reelbase.sources.files import listing
from reelbase.sources.storage import fresh_folder, written_once

__all__ = ["fresh_folder"]

FRAME_TYPES = {
    "action": "array<float>",
    "state": "array<float>",
    "timestamp": "float",
    "frame_index": "bigint",
    "episode_index": "bigint",
    "index": "bigint",
    "task_index": "bigint",
}
INFO = "repo_id string, codebase_version string, fps int, robot_type string, total_episodes long, total_frames long, total_tasks long, splits map<string,string>"
STATS = "repo_id string, stats map<string,map<string,array<double>>>"
FRAMES_A_TASK = 250_000  # that a merge sorts
STATISTICS = ("min", "max", "mean", "std", "count", "q01", "q10", "q50", "q90", "q99")


def as_dataset(frames: DataFrame, task: str = "concat('place the cube for ', split_part(repo_id, '_', 4), ' on the ', split_part(repo_id, '_', 5))") -> DataFrame:
    """The frames view in the shape of a dataset: repo_id, vectors, running index per repo, task."""
    named = repo_names(frames).withColumn("task", F.expr(task))
    vectors = named.withColumn("action", F.array(*JOINTS))
    before = F.expr("coalesce(lag(action) OVER (PARTITION BY repo_no, episode_index ORDER BY frame_index), action)")
    numbered, _ = renumbered(vectors.withColumn("state", before), ["repo_no", "episode_index"], "frame_index", within=["repo_no"])
    return numbered.withColumn("task_index", F.lit(0).cast("long"))


def write_frames(data: DataFrame, root: str, mode: str = "errorifexists") -> None:
    """Frames in the exact storage types, a folder for each repo. Modes: errorifexists, overwrite, ignore (an existing dataset stays as it is)."""
    stored = data.select("repo_id", *[F.col(c).cast(t).alias(c) for c, t in FRAME_TYPES.items()])
    stored.write.partitionBy("repo_id").mode(mode).parquet(f"{root}/data")


def episode_table(data: DataFrame) -> DataFrame:
    """repo_id, episode_index, tasks, length, dataset_from_index, dataset_to_index, and ``stats``: statistic -> value per joint."""
    keys = ["repo_id", "episode_index"]
    base = data.groupBy(*keys).agg(
        F.array_sort(F.collect_set("task")).alias("tasks"),
        F.count(F.lit(1)).alias("length"),
        F.min("index").alias("dataset_from_index"),
        (F.max("index") + 1).alias("dataset_to_index"),
    )
    return base.join(nested(dimension_stats(with_joints(data), keys, list(JOINTS)), keys), keys)


def with_joints(data: DataFrame) -> DataFrame:
    return data.withColumns({j: F.element_at("action", i + 1).cast("double") for i, j in enumerate(JOINTS)})


def nested(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Long statistics as one map per group: statistic -> values in the order of the joints."""
    order = F.expr("array_position(array('" + "','".join(JOINTS) + "'), dim)")
    values = F.struct(order.alias("o"), *[F.col(s).cast("double").alias(s) for s in STATISTICS])
    sorted_rows = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(values)).alias("x"))
    pairs = [y for s in STATISTICS for y in (F.lit(s), F.expr(f"transform(x, r -> r.{s})"))]
    return sorted_rows.select(*keys, F.create_map(*pairs).alias("stats"))


def write_meta(data: DataFrame, root: str, mode: str = "errorifexists", robot: str = "arm", version: str = "v3") -> None:
    """Episodes with their statistics, tasks, info and global statistics of what the frames hold."""
    episode_table(data).write.partitionBy("repo_id").mode(mode).parquet(f"{root}/meta/episodes")
    data.select("repo_id", "task_index", "task").distinct().write.mode(mode).parquet(f"{root}/meta/tasks")
    counts = data.groupBy("repo_id").agg(F.countDistinct("episode_index").alias("total_episodes"), F.count(F.lit(1)).alias("total_frames"), F.countDistinct("task_index").alias("total_tasks"))
    info = counts.selectExpr(
        "repo_id", f"'{version}' AS codebase_version", f"{FPS} AS fps", f"'{robot}' AS robot_type", "total_episodes", "total_frames", "total_tasks", "map('train', concat('0:', total_episodes)) AS splits"
    )
    info.write.mode(mode).json(f"{root}/meta/info")
    stats = nested(large_stats(with_joints(data), ["repo_id"], list(JOINTS)), ["repo_id"])
    stats.select("repo_id", F.create_map(F.lit("action"), "stats").alias("stats")).write.mode(mode).json(f"{root}/meta/stats")


def scan_frames(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """The named columns of the frames of all repos; repo_id comes from the folder, so a filter on it prunes folders."""
    return spark.read.parquet(f"{root}/data").select(*columns)


def scan_episodes(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{root}/meta/episodes").select(*columns)


def scan_tasks(spark: SparkSession, root: str) -> DataFrame:
    """The distinct task strings of each repo, flattened from the episodes' lists, sorted."""
    return scan_episodes(spark, root, ["repo_id", F.explode("tasks").alias("task")]).groupBy("repo_id").agg(F.array_sort(F.collect_set("task")).alias("tasks"))


def scan_info(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INFO).json(f"{root}/meta/info")


def scan_stats(spark: SparkSession, root: str) -> DataFrame:
    """Global statistics in long form: repo_id, feature, statistic, dim, value."""
    stats = spark.read.schema(STATS).json(f"{root}/meta/stats")
    return stats.select("repo_id", F.explode("stats").alias("feature", "s")).select("repo_id", "feature", F.explode("s").alias("statistic", "v")).select("repo_id", "feature", "statistic", F.posexplode("v").alias("dim", "value"))


def verified(spark: SparkSession, root: str) -> DataFrame:
    """Per repo: what the info promises against what frames and episodes hold."""
    frames = scan_frames(spark, root, ["repo_id", "episode_index"]).groupBy("repo_id").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("episode_index").alias("frame_episodes"))
    episodes = scan_episodes(spark, root, ["repo_id", "length"]).groupBy("repo_id").agg(F.count(F.lit(1)).alias("episodes"), F.sum("length").alias("length"))
    both = scan_info(spark, root).join(frames, "repo_id", "left").join(episodes, "repo_id", "left")
    equal = F.expr("total_frames <=> frames AND total_frames <=> length AND total_episodes <=> episodes AND total_episodes <=> frame_episodes")
    return both.select("repo_id", "total_episodes", "total_frames", equal.alias("equal"))


def checked(spark: SparkSession, root: str) -> DataFrame:
    """As :func:`verified`, but a difference is an error."""
    v = verified(spark, root)
    return v.withColumn("equal", F.when(F.col("equal"), True).otherwise(F.raise_error(F.concat(F.lit("counts differ in "), "repo_id")).cast("boolean")))


def discovered(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """The repos under a root whose name matches, sorted, by listing its folders; no file is opened."""
    folders = listing(spark, f"{root}/data", depth=0, recursive=False).where("is_dir")
    name = F.regexp_extract("name", "^repo_id=(.*)$", 1)
    return folders.select(name.alias("repo_id")).where((F.col("repo_id") != "") & F.col("repo_id").rlike(pattern)).orderBy("repo_id")


def write_report(rows: DataFrame, root: str, name: str, parameters: dict[str, str]) -> None:
    """A CSV of the rows with a header, and a manifest in JSON lines: one line of rule parameters and totals, then one line per row."""
    rows.write.option("header", True).mode("errorifexists").csv(f"{root}/{name}-csv")
    given = F.create_map(*[F.lit(x) for kv in sorted(parameters.items()) for x in kv]) if parameters else F.expr("map()").cast("map<string,string>")
    total = rows.agg(F.count(F.lit(1)).alias("n")).select(F.to_json(F.struct(given.alias("parameters"), F.col("n").alias("rows"))).alias("value"))
    total.unionByName(rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))).write.mode("errorifexists").text(f"{root}/{name}-json")


def append_records(records: DataFrame, root: str, name: str, run: str) -> None:
    """Append one record per processed unit. The header is the run's name, which every record carries, so no first line has to be kept apart."""
    records.withColumn("run", F.lit(run)).write.mode("append").json(f"{root}/{name}")


def inventory(files: DataFrame, group: str) -> DataFrame:
    """Number and total bytes of files in each group; files have ``length``, as the binaryFile source gives it without reading any content."""
    return files.groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def merge_shards(spark: SparkSession, shards: str, reports: DataFrame, out: str) -> DataFrame:
    """Merge the shards of each target into one dataset. ``shards`` has the frames below target=<target>/shard=<number>/; ``reports`` has a row for each planned shard: target, shard,
    ``error`` (null if it went well). A target with a failed shard, or one whose folder is missing, is skipped, and what was published of it before stays as it is; the others
    are numbered anew, in the order of shard, episode and frame, and replace theirs. The replacing is by partition, at the end of one job: if that fails, all targets stay.

    Returns target, merged, shards, failed (numbers of the failed shards) and reason."""
    data = spark.read.parquet(shards)
    there = data.select("target", "shard").distinct().withColumn("_there", F.lit(True))  # folders
    kinds = {c: data.schema[c].dataType for c in ("target", "shard")}
    planned = reports.select(*[F.col(c).cast(kinds[c]).alias(c) for c in kinds], "error").join(there, ["target", "shard"], "left")
    wrong = F.coalesce("error", F.when(F.col("_there").isNull(), F.lit("missing")))
    state = planned.groupBy("target").agg(F.count(F.lit(1)).alias("shards"), F.array_sort(F.collect_list(F.when(wrong.isNotNull(), F.col("shard")))).alias("failed"))
    summary = written_once(
        state.select("target", (F.size("failed") == 0).alias("merged"), "shards", "failed", F.when(F.size("failed") > 0, F.concat(F.size("failed").cast("string"), F.lit("/"), F.col("shards").cast("string"), F.lit(" shards failed"))).alias("reason")), "merged-shards"
    )
    good = summary.where("merged").select("target")
    # a row for each target and planned shard: both are sent to the frames, which else would be dealt by shard, a shard to a task
    whole = data.join(F.broadcast(good), "target", "left_semi").join(F.broadcast(planned.select("target", "shard")), ["target", "shard"], "left_semi")
    numbered, _ = renumbered(whole, ["target", "shard", "episode_index"], "frame_index", within=["target"], rows_a_task=FRAMES_A_TASK)
    merged = numbered.drop("shard", "episode_index", "frame_index").withColumnsRenamed({"episode_no": "episode_index", "frame_no": "frame_index"}).drop("from_index")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target").parquet(out)
    return summary
