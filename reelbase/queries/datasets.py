"""Queries of sources, sinks, merging and numbering: each writes a dataset and reads it back, or numbers frames anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbase.operators import timeseries as T
from reelbase.queries.base import IDENTITY, LEN, REPO, SLOT, query, r6
from reelbase.sources import datasets as D
from reelbase.sources.adapters import JOINTS, frames_of, read

TASK = f"'place the cube for ' || split_part({IDENTITY}, '_', 2) || ' on the ' || {SLOT}"
#: Frames with their running index inside their repo.
INDEXED = f"""{LEN}, e AS (SELECT repo_no, episode_index, n, sum(n) OVER (PARTITION BY repo_no ORDER BY episode_index) - n AS f0 FROM length_),
 x AS (SELECT f.*, {REPO} AS repo_id, {TASK} AS task, n, f0, f0 + frame_index AS index FROM frames f JOIN e USING (repo_no, episode_index))"""


def written(s, d, frames=True, meta=True) -> str:
    root, data = D.fresh_folder(s, "dataset"), D.as_dataset(frames_of(s, d))
    if frames:
        D.write_frames(data, root)
    if meta:
        D.write_meta(data, root)
    return root


@query("src_01_scan_frames", f"""WITH {INDEXED} SELECT repo_id, count(*) AS frames, CAST(sum(index) AS BIGINT) AS index_sum, sum(pan) AS pan_sum,
 CAST(round(max(frame_index / 30.0) * 30) AS BIGINT) AS last_frame FROM x GROUP BY 1""")
def src_01(s, d):
    f = D.scan_frames(s, written(s, d, meta=False), ["repo_id", "action", "timestamp", "index"])
    pan = F.sum(F.element_at("action", 1).cast("double"))
    return f.groupBy("repo_id").agg(F.count(F.lit(1)).alias("frames"), F.sum("index").alias("index_sum"), pan.alias("pan_sum"), F.round(F.max("timestamp") * 30).cast("long").alias("last_frame"))


@query("src_02_scan_episodes", f"""WITH {INDEXED} SELECT repo_id, episode_index, max(n) AS length, CAST(min(index) AS BIGINT) AS dataset_from_index, CAST(max(index) + 1 AS BIGINT) AS dataset_to_index,
 max(lift) AS lift_max FROM x GROUP BY 1, 2""")
def src_02(s, d):
    columns = ["repo_id", "episode_index", "length", "dataset_from_index", "dataset_to_index", F.expr("stats['max'][1]").alias("lift_max")]
    return D.scan_episodes(s, written(s, d, frames=False), columns)


@query("src_03_scan_tasks", f"SELECT DISTINCT {REPO} AS repo_id, {TASK} AS tasks FROM frames")
def src_03(s, d):
    return D.scan_tasks(s, written(s, d, frames=False)).select("repo_id", F.array_join("tasks", "|").alias("tasks"))


@query("src_04_scan_info", f"SELECT {REPO} AS repo_id, 30 AS fps, 'arm' AS robot_type, count(DISTINCT episode_index) AS total_episodes, count(*) AS total_frames, CAST(1 AS BIGINT) AS total_tasks FROM frames GROUP BY 1")
def src_04(s, d):
    return D.scan_info(s, written(s, d, frames=False)).select("repo_id", "fps", "robot_type", "total_episodes", "total_frames", "total_tasks")


def _global(stat: str, expression: str) -> str:
    return " UNION ALL ".join(f"SELECT {REPO} AS repo_id, '{stat}' AS statistic, {i} AS dim, round({expression.format(j)}, 6) AS value FROM frames GROUP BY 1" for i, j in enumerate(JOINTS))


@query("src_05_scan_stats", " UNION ALL ".join(_global(k, e) for k, e in (("mean", "avg({})"), ("std", "stddev_pop({})"), ("count", "CAST(count({}) AS DOUBLE)"), ("q50", "quantile_cont({}, 0.5)"))))
def src_05(s, d):
    stats = D.scan_stats(s, written(s, d, frames=False)).where("feature = 'action' AND statistic IN ('mean', 'std', 'count', 'q50')")
    return stats.select("repo_id", "statistic", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


@query("snk_04_report_csv", f"SELECT {REPO} AS repo_id, count(*) AS frames FROM frames GROUP BY 1")
def snk_04(s, d):
    root = D.fresh_folder(s, "report")
    D.write_report(D.as_dataset(frames_of(s, d)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("frames")), root, "frames", {"cap": "none"})
    return s.read.option("header", True).schema("repo_id string, frames long").csv(f"{root}/frames-csv")


@query("snk_05_manifest", f"""SELECT 'none' AS cap, CAST(count(DISTINCT repo_no) AS BIGINT) AS rows, NULL AS repo_id, CAST(NULL AS BIGINT) AS frames FROM frames
 UNION ALL SELECT NULL, NULL, {REPO}, count(*) FROM frames GROUP BY 3""")
def snk_05(s, d):
    root = D.fresh_folder(s, "manifest")
    D.write_report(D.as_dataset(frames_of(s, d)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("frames")), root, "frames", {"cap": "none"})
    m = s.read.schema("parameters map<string,string>, rows long, repo_id string, frames long").json(f"{root}/frames-json")
    return m.select(F.col("parameters")["cap"].alias("cap"), "rows", "repo_id", "frames")


@query("snk_06_append", f"SELECT run, {REPO} AS repo_id, count(*) AS frames FROM frames, (SELECT unnest(['a', 'b']) AS run) r GROUP BY 1, 2")
def snk_06(s, d):
    root, counts = D.fresh_folder(s, "records"), D.as_dataset(frames_of(s, d)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("frames"))
    for run in ("a", "b"):
        D.append_records(counts, root, "metrics", run)
    return s.read.schema("run string, repo_id string, frames long").json(f"{root}/metrics")


@query("snk_07_write_policy", "SELECT count(*) AS kept, count(*) FILTER (WHERE repo_no < 3) AS replaced FROM frames")
def snk_07(s, d):
    root, data = D.fresh_folder(s, "policy"), D.as_dataset(frames_of(s, d))
    D.write_frames(data, root)
    D.write_frames(data.where("repo_no < 3"), root, "ignore")
    kept = D.scan_frames(s, root, ["index"]).agg(F.count(F.lit(1)).alias("kept"))
    other = f"{root}-replaced"
    D.write_frames(data, other)
    D.write_frames(data.where("repo_no < 3"), other, "overwrite")
    return kept.crossJoin(D.scan_frames(s, other, ["index"]).agg(F.count(F.lit(1)).alias("replaced")))  # one row each


@query("snk_08_verify", f"SELECT {REPO} AS repo_id, count(DISTINCT episode_index) AS total_episodes, count(*) AS total_frames, true AS equal FROM frames GROUP BY 1")
def snk_08(s, d):
    return D.checked(s, written(s, d))


RENUMBERED = f"""{LEN}, e AS (SELECT repo_no, episode_index, n, row_number() OVER w - 1 AS episode_no, CAST(sum(n) OVER w - n AS BIGINT) AS f0 FROM length_ WINDOW w AS (ORDER BY repo_no, episode_index))"""


@query("ts_16_episodes", f"WITH {RENUMBERED} SELECT repo_no, episode_index, n AS length, episode_no, f0 AS from_index, f0 + n AS to_index, round(f0 / 30.0, 6) AS from_time, round((f0 + n) / 30.0, 6) AS to_time FROM e")
def ts_16_episodes(s, d):
    return r6(T.renumbered(frames_of(s, d), ["repo_no", "episode_index"], "frame_index")[1], "from_time", "to_time")


@query("ts_16_frames", f"""WITH {RENUMBERED} SELECT {REPO} AS repo_id, event_id, episode_no, frame_index AS frame_no, f0 + frame_index AS index, round(frame_index / 30.0, 6) AS timestamp
 FROM frames JOIN e USING (repo_no, episode_index)""")
def ts_16_frames(s, d):
    # by the repo's name: keys of any type are numbered, the first key first
    named = D.repo_names(frames_of(s, d))
    return r6(T.renumbered(named, ["repo_id", "episode_index"], "frame_index")[0].select("repo_id", "event_id", "episode_no", "frame_no", "index", "timestamp"), "timestamp")


@query("set_01_concatenate", "SELECT count(*) AS frames, count(DISTINCT event_id) AS distinct_frames, CAST(sum(CASE WHEN repo_no = 0 THEN 1 ELSE 0 END) * 2 AS BIGINT) AS repeated FROM (SELECT * FROM frames WHERE repo_no IN (0, 3) UNION ALL SELECT * FROM frames WHERE repo_no = 0)")
def set_01(s, d):
    f = frames_of(s, d)
    mix = None
    for pos, repo in enumerate((0, 3, 0)):  # a bag: repo 0 twice
        one = f.where(F.col("repo_no") == repo).withColumn("mix_pos", F.lit(pos))
        mix = one if mix is None else mix.unionByName(one)
    n0 = F.count_if(F.col("repo_no") == 0)
    return mix.agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("event_id").alias("distinct_frames"), (n0 * 2).alias("repeated")).withColumn("repeated", F.col("repeated").cast("long"))


@query("set_02_merge", """WITH l AS (SELECT repo_no, episode_index, count(*) AS n FROM frames WHERE repo_no IN (1, 4, 7) GROUP BY 1, 2),
 e AS (SELECT repo_no, episode_index, n, row_number() OVER w - 1 AS episode_no, CAST(sum(n) OVER w - n AS BIGINT) AS f0 FROM l WINDOW w AS (ORDER BY repo_no, episode_index))
 SELECT episode_no, max(repo_no) AS repo_no, CAST(min(f0 + frame_index) AS BIGINT) AS from_index, CAST(max(f0 + frame_index) + 1 AS BIGINT) AS to_index, round(avg(pan), 6) AS pan_mean FROM frames JOIN e USING (repo_no, episode_index) GROUP BY 1""")
def set_02(s, d):
    merged, _ = T.renumbered(frames_of(s, d).where("repo_no IN (1, 4, 7)"), ["repo_no", "episode_index"], "frame_index")
    return merged.groupBy("episode_no").agg(F.max("repo_no").alias("repo_no"), F.min("index").alias("from_index"), (F.max("index") + 1).alias("to_index"), F.round(F.avg("pan"), 6).alias("pan_mean"))


@query("set_03_merge_shards", f"""WITH {LEN}, e AS (SELECT 't' || (repo_no % 3) AS target, repo_no // 3 AS shard, repo_no, episode_index, n FROM length_), k AS (SELECT * FROM e WHERE target <> 't1' OR shard = 0),
 p AS (SELECT *, row_number() OVER w - 1 AS no, sum(n) OVER w - n AS f0 FROM k WINDOW w AS (PARTITION BY target ORDER BY shard, episode_index))
 SELECT target, target <> 't1' AS merged, CASE WHEN target = 't1' THEN '2/3 shards failed' END AS reason, CAST(no AS BIGINT) AS episode_index, CAST(f0 AS BIGINT) AS from_index, count(*) AS frames, sum(pan) AS pan_sum
 FROM p JOIN frames f USING (repo_no, episode_index) GROUP BY ALL""")
def set_03(s, d):
    """Three targets of three shards each. An earlier run published the first shards; in the second one shard of target t1 reports an error and another is not there, so t1 stays as it was."""
    root = D.fresh_folder(s, "shards")
    f = frames_of(s, d).selectExpr("concat('t', repo_no % 3) AS target", "repo_no div 3 AS shard", "episode_index", "frame_index", "pan")
    f.where("shard = 0").write.partitionBy("target", "shard").parquet(f"{root}/first")
    report = lambda *rows: s.createDataFrame(list(rows), "target string, shard int, error string")
    D.merge_shards(s, f"{root}/first", report(*[(f"t{t}", 0, None) for t in range(3)]), f"{root}/out")
    f.where("NOT (target = 't1' AND shard = 2)").write.partitionBy("target", "shard").parquet(f"{root}/second")
    told = D.merge_shards(s, f"{root}/second", report(*[(f"t{t}", k, "worker died" if (t, k) == (1, 1) else None) for t in range(3) for k in range(3)]), f"{root}/out")
    e = s.read.parquet(f"{root}/out").groupBy("target", "episode_index").agg(F.min("index").cast("long").alias("from_index"), F.count(F.lit(1)).alias("frames"), F.sum("pan").alias("pan_sum"))
    return told.join(e, "target").select("target", "merged", "reason", F.col("episode_index").cast("long").alias("episode_index"), "from_index", "frames", "pan_sum")


@query("set_04_ordered_distinct", f"SELECT {REPO} AS repo_id, row_number() OVER (ORDER BY min(event_id)) AS pos FROM frames GROUP BY 1")
def set_04(s, d):
    first = D.repo_names(frames_of(s, d)).groupBy("repo_id").agg(F.min("event_id").alias("at"))
    # one row per repo
    return first.selectExpr("repo_id", "row_number() OVER (ORDER BY at) AS pos")


@query("set_06_uniform", "SELECT true AS uniform, CAST(1 AS BIGINT) AS kinds, count(DISTINCT repo_no) AS repos FROM frames")
def set_06(s, d):
    info = D.scan_info(s, written(s, d, frames=False))
    return info.agg((F.countDistinct("fps", "robot_type") == 1).alias("uniform"), F.countDistinct("fps", "robot_type").alias("kinds"), F.count(F.lit(1)).alias("repos"))


@query("set_07_held_out_present", "SELECT DISTINCT p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size >= 50)")
def set_07(s, d):
    p = read(s, d, "part")
    return p.select("p_brand").intersect(p.where("p_size >= 50").select("p_brand"))


@query("set_08_leakage", f"""SELECT count(*) FILTER (WHERE {SLOT} = 'left' AND {IDENTITY} = 'person_c') AS shared, count(DISTINCT CASE WHEN {IDENTITY} = 'person_c' THEN repo_no END) AS held_out, count(DISTINCT repo_no) = 9 AS lossless FROM frames""")
def set_08(s, d):
    f = D.repo_names(frames_of(s, d)).withColumn("evaluation", F.col("repo_id").rlike("_person_c_"))
    return f.agg(F.count_if(F.expr("evaluation AND repo_id LIKE '%\\\\_left\\\\_%'")).alias("shared"), F.countDistinct(F.when(F.col("evaluation"), F.col("repo_no"))).alias("held_out"), (F.countDistinct("repo_no") == 9).alias("lossless"))


@query("snk_01_storage_types", "SELECT CAST('action:array<float>,episode_index:bigint,frame_index:bigint,index:bigint,repo_id:string,state:array<float>,task_index:bigint,timestamp:float' AS VARCHAR) AS types, count(*) AS frames FROM frames")
def snk_01(s, d):
    f = D.scan_frames(s, written(s, d, meta=False), ["*"])
    types = ",".join(sorted(f"{x.name}:{x.dataType.simpleString()}" for x in f.schema))
    return f.agg(F.count(F.lit(1)).alias("frames")).withColumn("types", F.lit(types))


@query("snk_02_episode_statistics", f"SELECT {REPO} AS repo_id, episode_index, round(avg(pan), 6) AS pan_mean, round(stddev_pop(pan), 6) AS pan_std, round(quantile_cont(pan, 0.9), 6) AS pan_q90, CAST(count(*) AS DOUBLE) AS n FROM frames GROUP BY 1, 2")
def snk_02(s, d):
    at = lambda k: F.round(F.col("stats")[k][0], 6)
    columns = ["repo_id", "episode_index", at("mean").alias("pan_mean"), at("std").alias("pan_std"), at("q90").alias("pan_q90"), F.col("stats")["count"][0].alias("n")]
    return D.scan_episodes(s, written(s, d, frames=False), columns)


@query("snk_03_meta_tables", f"SELECT {REPO} AS repo_id, CAST(0 AS BIGINT) AS task_index, {TASK} AS task, '0:' || count(DISTINCT episode_index) AS train, CAST(60 AS BIGINT) AS statistics FROM frames GROUP BY repo_no")
def snk_03(s, d):
    root = written(s, d, frames=False)
    counts = D.scan_stats(s, root).groupBy("repo_id").agg(F.count(F.lit(1)).alias("statistics"))
    info = D.scan_info(s, root).select("repo_id", F.col("splits")["train"].alias("train"))
    return s.read.parquet(f"{root}/meta/tasks").join(info, "repo_id").join(counts, "repo_id").select("repo_id", "task_index", "task", "train", "statistics")


@query("snk_09_ranked_table", f"WITH r AS (SELECT {REPO} AS repo_id, count(*) AS frames, round(avg(gripper), 4) AS gripper FROM frames GROUP BY 1) SELECT row_number() OVER (ORDER BY gripper DESC, repo_id) AS place, repo_id, frames, gripper FROM r")
def snk_09(s, d):
    r = D.repo_names(frames_of(s, d)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("gripper"), 4).alias("gripper"))
    # one row per repo
    return r.selectExpr("row_number() OVER (ORDER BY gripper DESC, repo_id) AS place", "repo_id", "frames", "gripper")
