"""Checks on inputs with planted damage, totals of a filtered pool, and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbase.functions import tables
from reelbase.operators import gathers as G
from reelbase.operators import timeseries as T
from reelbase.operators.ranks import ranked
from reelbase.queries.base import EP, LEN, REPO, SLOT, query
from reelbase.queries.texts import PHOTO, REASON, photos, reason
from reelbase.sources import datasets as D
from reelbase.sources.adapters import frames_of
from reelbase.sources.storage import written_once


@query("ts_20_damaged", f"""WITH {LEN}, e AS (SELECT repo_no, episode_index, n, row_number() OVER (PARTITION BY repo_no ORDER BY episode_index) AS k, count(*) OVER (PARTITION BY repo_no) AS m FROM length_)
 SELECT repo_no, CAST(sum((repo_no = 1 AND (k = 2 OR (k = 3 AND m > 2)))::INT) AS BIGINT) AS gaps, CAST(sum((repo_no = 2 AND episode_index % 2 = 0 OR repo_no = 3 AND episode_index % 2 = 1)::INT) AS BIGINT) AS lengths,
 CAST(sum((repo_no = 4 AND episode_index % 2 = 0)::INT) AS BIGINT) AS numbers, CAST(sum((repo_no = 1 AND k = 2 OR repo_no = 5 AND episode_index % 2 = 0)::INT) AS BIGINT) AS indexes, CAST(sum((repo_no = 6 AND episode_index % 2 = 0)::INT) AS BIGINT) AS times FROM e GROUP BY 1""")
def ts_20_damaged(s, d):
    """Planted: in repo 1 the second episode is moved, in repo 2 lengths are wrong, in repo 3 the last frame is lost, in repo 4 a number is skipped (the index and the time with it), in repo 5 an index
    and in repo 6 a timestamp is off; the others are whole."""
    f = T.with_length(frames_of(s, d))
    frames, episodes = T.renumbered(f.select(*EP, "frame_index", "n"), EP, "frame_index", within=["repo_no"])
    frames, episodes = written_once(frames, "frames"), written_once(episodes, "episodes")
    repo, even, last = F.col("repo_no"), F.col("episode_index") % 2 == 0, F.col("frame_index") == F.col("n") - 1
    skip = ((repo == 4) & even & last).cast("int") * 5
    frames = frames.where(~((repo == 3) & ~even & last)).select(*EP, (F.col("frame_index") + skip).alias("frame_index"), (F.col("index") + skip + ((repo == 5) & even & last).cast("int")).alias("index"), ((F.col("frame_index") + skip) / 30 + F.when((repo == 6) & even & last, 0.001).otherwise(0.0)).alias("timestamp"))
    moved = F.lit(7) * ((repo == 1) & (F.col("k") == 1)).cast("int")
    episodes = ranked(episodes, ["repo_no"], ["episode_index"], "k").withColumn("_s", moved).select(*EP, (F.col("length") + ((repo == 2) & even).cast("int")).alias("length"), (F.col("from_index") + F.col("_s")).alias("from_index"), (F.col("to_index") + F.col("_s")).alias("to_index"))
    return G.contiguous(frames, episodes)


@query("ts_21_damaged", f"""WITH {LEN} SELECT repo_no, episode_index, CAST(CASE episode_index % 4 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS BIGINT) AS changes, episode_index % 4 = 0 AS once FROM length_ WHERE n > 8""")
def ts_21_damaged(s, d):
    """Flags that flip where they should, one frame late, twice, and never."""
    f = T.with_length(frames_of(s, d)).where("n > 8").withColumn("at", F.floor(F.col("n") / 3).cast("long"))
    flag = F.expr("CASE episode_index % 4 WHEN 0 THEN frame_index <= at WHEN 1 THEN frame_index <= at + 1 WHEN 2 THEN frame_index <= at OR frame_index = n - 1 ELSE true END")
    return G.flips_once(f.withColumn("flag", flag), "flag", "at")


@query("agg_10_pool_totals", f"""WITH p AS (SELECT *, {REASON} AS reason, area * 1000 + w * h / 1000.0 AS score FROM ({PHOTO})), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, reason = 'OK' ORDER BY score DESC, p_partkey) AS r FROM p)
 SELECT p_brand, count(*) FILTER (WHERE reason = 'OK') AS kept, count(*) FILTER (WHERE reason <> 'OK') AS dropped, round(avg((reason = 'OK')::INT), 6) AS kept_share, coalesce(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY r) FILTER (WHERE reason = 'OK' AND r <= 10), '') AS best FROM k GROUP BY 1""")
def agg_10_totals(s, d):
    """Per brand: photos kept and dropped, and the ten best of those kept, best first."""
    p = photos(s, d).withColumn("reason", reason()).select("p_brand", "p_partkey", (F.col("reason") == "OK").alias("ok"), F.expr("area * 1000 + w * h / 1000.0D").alias("score"))
    totals = p.groupBy("p_brand").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("dropped"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("kept_share"))
    best = p.where("ok").withColumn("r", F.expr("row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey)")).where("r <= 10")
    named = best.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p_partkey"))), lambda x: x.p_partkey.cast("string")), ",").alias("best"))
    return totals.join(named, "p_brand", "left").withColumn("best", F.coalesce("best", F.lit("")))


@query("udf_03_bridge_table", f"""WITH {LEN}, e AS (SELECT repo_no, episode_index, arg_min(pan, frame_index) AS p0, arg_max(pan, frame_index) AS p1, arg_min(lift, frame_index) AS l0, arg_max(lift, frame_index) AS l1 FROM frames JOIN length_ USING (repo_no, episode_index) WHERE n > 1 GROUP BY 1, 2)
 SELECT repo_no, episode_index, CAST(i AS INT) AS step, round(p0 + (p1 - p0) * (i + 1) / 6.0, 6) AS pan, round(l0 + (l1 - l0) * (i + 1) / 6.0, 6) AS lift FROM e, range(0, 5) r(i)""")
def udf_03_bridge(s, d):
    tables.register(s)
    ends = T.with_length(frames_of(s, d)).where("frame_index IN (0, n - 1)").select(*EP, "frame_index", F.array("pan", "lift").alias("vector"))
    rows = s.sql("SELECT * FROM bridge_rows(TABLE({ends}) PARTITION BY (repo_no, episode_index) ORDER BY (frame_index), 5)", ends=ends)
    return rows.select(*EP, "step", F.round(F.col("vector")[0], 6).alias("pan"), F.round(F.col("vector")[1], 6).alias("lift"))


@query("dq_15_damaged", f"""WITH c AS (SELECT repo_no, count(*) AS n, count(*) FILTER (WHERE NOT (repo_no % 3 = 1 AND episode_index % 2 = 0)) AS k FROM frames GROUP BY 1)
 SELECT {REPO} AS repo_id, CASE WHEN repo_no <> 2 THEN CAST(n AS DOUBLE) END AS stored, k AS frames, repo_no <> 2 AND n = k AS equal FROM c""")
def dq_15_damaged(s, d):
    """Stored statistics against a corpus that has lost episodes since, and one repo whose statistics are missing."""
    data, root = written_once(D.as_dataset(frames_of(s, d)), "corpus"), D.fresh_folder(s, "stats")
    D.write_meta(data, root)
    stored = D.scan_stats(s, root).where("statistic = 'count' AND dim = 0 AND repo_id <> 'dataset_v2_person_a_right_1'").select("repo_id", F.col("value").alias("stored"))
    counts = data.where("NOT (repo_no % 3 = 1 AND episode_index % 2 = 0)").groupBy("repo_id").agg(F.count(F.lit(1)).alias("frames"))
    both = D.scan_info(s, root).select("repo_id").join(stored, "repo_id", "left").join(counts, "repo_id", "left").withColumn("frames", F.coalesce("frames", F.lit(0).cast("long")))
    return both.withColumn("equal", F.coalesce(F.col("stored") == F.col("frames"), F.lit(False)))


@query("dq_14_task_histogram", f"""WITH t AS (SELECT repo_no, episode_index, 'place it on the ' || {SLOT} || CASE WHEN episode_index % 4 = 0 THEN ' slowly' ELSE '' END AS task, count(*) AS n FROM frames GROUP BY 1, 2)
 SELECT {REPO} AS repo_id, task, count(*) AS episodes, CAST(sum(n) AS BIGINT) AS frames, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY repo_no) AS DOUBLE), 6) AS share, CAST(min(episode_index) AS BIGINT) AS first_episode FROM t GROUP BY repo_no, task""")
def dq_14_histogram(s, d):
    """Per repo and text: episodes, frames, its share of the repo's episodes and the first episode with it."""
    data = D.as_dataset(frames_of(s, d), "concat('place it on the ', split_part(repo_id, '_', 5), if(episode_index % 4 = 0, ' slowly', ''))")
    h = data.groupBy("repo_id", "task").agg(F.countDistinct("episode_index").alias("episodes"), F.count(F.lit(1)).alias("frames"), F.min("episode_index").alias("first_episode"))
    h = written_once(h, "histogram")  # a row per repo and text
    total = h.groupBy("repo_id").agg(F.sum("episodes").alias("_all"))
    return h.join(total, "repo_id").select("repo_id", "task", "episodes", "frames", F.round(F.col("episodes") / F.col("_all"), 6).alias("share"), "first_episode")
