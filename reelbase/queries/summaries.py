"""Queries of aggregations over repos, mixes and recipes, and of stateful ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbase.operators import stats
from reelbase.operators import timeseries as T
from reelbase.queries.base import EP, IDENTITY, LEN, REPO, query, r6
from reelbase.queries.gathers import named
from reelbase.sources import datasets as D
from reelbase.sources.adapters import JOINTS, frames_of, read
from reelbase.streaming import guards, playback


@query("agg_04_recipe_stats", """WITH r AS (SELECT CASE WHEN repo_no IN (0, 1) THEN 'old' ELSE 'new' END AS source, * FROM frames WHERE repo_no IN (0, 1, 7)),
 v AS (SELECT source, unnest([0, 1, 6]) AS dim, unnest([pan, lift, 0]) AS x FROM r) SELECT source, dim, dim < 6 AS used, count(*) AS count, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM v GROUP BY 1, 2""")
def agg_04(s, d):
    r = frames_of(s, d).where("repo_no IN (0, 1, 7)").withColumn("source", F.when(F.col("repo_no") <= 1, "old").otherwise("new"))
    padded = r.withColumn("pad", F.lit(0.0))
    long = stats.large_stats(padded, ["source"], ["pan", "lift", "pad"])
    dim = F.when(F.col("dim") == "pan", 0).when(F.col("dim") == "lift", 1).otherwise(6)
    return r6(long.select("source", dim.alias("dim"), (dim < 6).alias("used"), "count", "mean", "std"), "mean", "std")


@query("agg_05_chunk_stats", f"""WITH {LEN} SELECT i AS step, count(*) AS count, round(avg(b.pan), 6) AS mean, min(b.pan) AS min, max(b.pan) AS max FROM frames a JOIN length_ USING (repo_no, episode_index), range(0, 5) r(i), frames b
 WHERE b.repo_no = a.repo_no AND b.episode_index = a.episode_index AND b.frame_index = least(a.frame_index + i, n - 1) GROUP BY 1""")
def agg_05(s, d):
    c = T.action_chunks(frames_of(s, d), "pan", 5).select(F.posexplode("chunk").alias("step", "x"))
    return c.groupBy(F.col("step").cast("long").alias("step")).agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))


@query("agg_07_initial_fraction", f"""WITH {LEN}, e AS (SELECT repo_no, episode_index, min(gripper) AS lo, max(gripper) AS hi FROM frames JOIN length_ USING (repo_no, episode_index) WHERE frame_index < greatest(1, floor(n * 0.2)) GROUP BY 1, 2),
 q AS (SELECT repo_no, quantile_cont(gripper, 0.1) AS p10, quantile_cont(gripper, 0.5) AS p50, quantile_cont(gripper, 0.9) AS p90 FROM frames JOIN length_ USING (repo_no, episode_index) WHERE frame_index < greatest(1, floor(n * 0.2)) GROUP BY 1)
 SELECT repo_no, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, round(avg(lo), 6) AS mean_min, round(avg(hi), 6) AS mean_max FROM e JOIN q USING (repo_no) GROUP BY 1, 2, 3, 4""")
def agg_07(s, d):
    f = T.with_length(frames_of(s, d)).where("frame_index < greatest(1, floor(n * 0.2))")
    q = stats.exact_quantiles(f, ["repo_no"], "gripper", (0.1, 0.5, 0.9)).withColumnsRenamed({"q0": "p10", "q1": "p50", "q2": "p90"})
    e = f.groupBy(*EP).agg(F.min("gripper").alias("lo"), F.max("gripper").alias("hi")).groupBy("repo_no").agg(F.avg("lo").alias("mean_min"), F.avg("hi").alias("mean_max"))
    return r6(q.join(e, "repo_no"), "p10", "p50", "p90", "mean_min", "mean_max")


SEPARABLE = """WITH e AS (SELECT repo_no, episode_index, avg(pan) FILTER (WHERE frame_index < 10) AS pan, avg(lift) FILTER (WHERE frame_index < 10) AS lift FROM frames GROUP BY 1, 2),
 g AS (SELECT repo_no // 3 AS identity, 'pan' AS joint, avg(pan) AS m, stddev_pop(pan) AS sd FROM e GROUP BY 1 UNION ALL SELECT repo_no // 3, 'lift', avg(lift), stddev_pop(lift) FROM e GROUP BY 1),
 p AS (SELECT a.joint, a.identity AS a, b.identity AS b, abs(a.m - b.m) AS gap, greatest(a.sd, b.sd) AS spread FROM g a JOIN g b ON a.joint = b.joint AND a.identity < b.identity)"""


def separability(s, d):
    """Per joint and pair of identities: difference of means and the larger deviation of the episodes' start pose; OK from a gap of 1 and below a deviation of 30."""
    e = frames_of(s, d).where("frame_index < 10").groupBy(*EP).agg(F.avg("pan").alias("pan"), F.avg("lift").alias("lift"))
    long = e.withColumn("identity", F.expr("repo_no div 3")).unpivot("identity", ["pan", "lift"], "joint", "x")
    g = long.groupBy("identity", "joint").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    b = g.select("joint", F.col("identity").alias("b"), F.col("m").alias("mb"), F.col("sd").alias("sdb"))
    pairs = g.withColumnRenamed("identity", "a").join(b, "joint").where("a < b")
    return pairs.select("joint", "a", "b", F.abs(F.col("m") - F.col("mb")).alias("gap"), F.greatest("sd", "sdb").alias("spread"))


@query("agg_12_separability", f"{SEPARABLE} SELECT joint, a, b, round(gap, 6) AS gap, round(spread, 6) AS spread, gap >= 1 AND spread < 30 AS ok FROM p")
def agg_12(s, d):
    return r6(separability(s, d).withColumn("ok", F.expr("gap >= 1 AND spread < 30")), "gap", "spread")


@query("dq_05_separable_joints", f"{SEPARABLE} SELECT joint, bool_and(gap >= 1 AND spread < 30) AS separable, count(*) AS pairs FROM p GROUP BY 1")
def dq_05(s, d):
    return separability(s, d).groupBy("joint").agg(F.bool_and(F.expr("gap >= 1 AND spread < 30")).alias("separable"), F.count(F.lit(1)).alias("pairs"))


@query("agg_13_fraction_pass", f"WITH {LEN} SELECT repo_no, round(avg(CASE WHEN n >= 65 THEN 1.0 ELSE 0 END), 6) AS share, avg(CASE WHEN n >= 65 THEN 1.0 ELSE 0 END) >= 0.5 AS pass FROM length_ GROUP BY 1")
def agg_13(s, d):
    e = frames_of(s, d).groupBy(*EP).agg(F.count(F.lit(1)).alias("n"))
    share = F.avg((F.col("n") >= 65).cast("double"))
    return e.groupBy("repo_no").agg(F.round(share, 6).alias("share"), (share >= 0.5).alias("pass"))


@query("agg_14_task_histogram", "SELECT p_name AS task, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, task LIMIT 20")
def agg_14(s, d):
    return read(s, d, "part").groupBy(F.col("p_name").alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "task").limit(20)  # a report of the first 20


BALANCE = """WITH p AS (SELECT repo_no // 3 AS identity, CASE WHEN abs(avg(pan)) <= 5 THEN 'middle' WHEN avg(pan) > 0 THEN 'left' ELSE 'right' END AS slot FROM frames GROUP BY repo_no // 3, episode_index),
 c AS (SELECT identity, count(*) FILTER (WHERE slot = 'left') AS l, count(*) FILTER (WHERE slot = 'middle') AS m, count(*) FILTER (WHERE slot = 'right') AS r, count(*) AS n FROM p GROUP BY 1),
 v AS (SELECT identity, l AS "left", m AS middle, r AS "right", round(greatest(abs(l / n - 1 / 3), abs(m / n - 1 / 3), abs(r / n - 1 / 3)), 6) AS deviation, CAST((l = 0)::INT + (m = 0)::INT + (r = 0)::INT AS INT) AS missing FROM c)"""


def balance(s, d):
    """Episodes per slot for each identity, the largest deviation from a third, and how many slots are missing."""
    mean = F.avg("pan")
    slot = F.when(F.abs(mean) <= 5, "middle").when(mean > 0, "left").otherwise("right")
    p = frames_of(s, d).withColumn("identity", F.expr("repo_no div 3")).groupBy("identity", "episode_index").agg(slot.alias("slot"))
    c = p.groupBy("identity").agg(*[F.count_if(F.col("slot") == x).alias(x) for x in ("left", "middle", "right")], F.count(F.lit(1)).alias("n"))
    off = F.greatest(*[F.abs(F.col(x) / F.col("n") - 1 / 3) for x in ("left", "middle", "right")])
    missing = sum(((F.col(x) == 0).cast("int") for x in ("middle", "right")), (F.col("left") == 0).cast("int"))
    return c.select("identity", "left", "middle", "right", F.round(off, 6).alias("deviation"), missing.alias("missing"))


@query("agg_15_slot_balance", f"{BALANCE} SELECT *, deviation <= 0.2 AND missing = 0 AS balanced FROM v")
def agg_15(s, d):
    return balance(s, d).withColumn("balanced", F.expr("deviation <= 0.2 AND missing = 0"))


@query("dq_11_slot_preflight", f"{BALANCE} SELECT identity, CASE WHEN missing > 0 THEN 'FAIL' WHEN deviation > 0.2 THEN 'WEAK' ELSE 'PASS' END AS verdict FROM v")
def dq_11(s, d):
    return balance(s, d).select("identity", F.when(F.col("missing") > 0, "FAIL").when(F.col("deviation") > 0.2, "WEAK").otherwise("PASS").alias("verdict"))


@query("agg_16_mix_totals", "WITH m AS (SELECT repo_no, count(*) AS frames, count(DISTINCT episode_index) AS episodes, repo_no % 3 AS w FROM frames GROUP BY 1) SELECT CAST(sum(frames) FILTER (WHERE w > 0) AS BIGINT) AS raw_frames, CAST(sum(frames * w) AS BIGINT) AS virtual_frames, CAST(sum(episodes) FILTER (WHERE w > 0) AS BIGINT) AS raw_episodes, CAST(sum(episodes * w) AS BIGINT) AS virtual_episodes FROM m")
def agg_16(s, d):
    m = frames_of(s, d).groupBy("repo_no").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("episode_index").alias("episodes")).withColumn("w", F.col("repo_no") % 3)
    used = F.col("w") > 0
    return m.agg(F.sum(F.when(used, F.col("frames"))).alias("raw_frames"), F.sum(F.col("frames") * F.col("w")).alias("virtual_frames"), F.sum(F.when(used, F.col("episodes"))).alias("raw_episodes"), F.sum(F.col("episodes") * F.col("w")).alias("virtual_episodes"))


@query("agg_17_truncation_summary", """WITH m AS (SELECT repo_no, episode_index, max(frame_index) FILTER (WHERE gripper >= 20 AND lift >= -30) AS l, count(*) AS n FROM frames GROUP BY 1, 2), t AS (SELECT *, CASE WHEN l IS NULL THEN least(40, n) ELSE least(l + 1, 40, n) END AS kept FROM m)
 SELECT repo_no, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(n - kept) AS BIGINT) AS dropped, round(sum(kept) / sum(n), 6) AS kept_share, round(avg(CASE WHEN l IS NULL THEN 0.0 ELSE 1 END), 6) AS match_rate, round(avg(kept), 6) AS kept_mean FROM t GROUP BY 1""")
def agg_17(s, d):
    t = T.truncation(frames_of(s, d), "last", 5, 40)
    return r6(t.groupBy("repo_no").agg(F.sum("kept").alias("kept"), F.sum(F.col("length") - F.col("kept")).alias("dropped"), (F.sum("kept") / F.sum("length")).alias("kept_share"), F.avg(F.col("last_match").isNotNull().cast("int")).alias("match_rate"), F.avg("kept").alias("kept_mean")), "kept_share", "match_rate", "kept_mean")


@query("agg_20_step_budget", "SELECT repo_no, CAST(ceil(count(*) / 64.0) AS BIGINT) AS steps_per_epoch, CAST(ceil(count(*) / 64.0) * 12 AS BIGINT) AS recommended FROM frames GROUP BY 1")
def agg_20(s, d):
    steps = F.ceil(F.count(F.lit(1)) / 64.0)
    return frames_of(s, d).groupBy("repo_no").agg(steps.cast("long").alias("steps_per_epoch"), (steps * 12).cast("long").alias("recommended"))


@query("agg_23_home_pose", "SELECT " + ", ".join(f"round(avg({j}), 6) AS {j}" for j in JOINTS) + " FROM frames WHERE frame_index < 5")
def agg_23(s, d):
    return frames_of(s, d).where("frame_index < 5").agg(*[F.round(F.avg(j), 6).alias(j) for j in JOINTS])


@query("set_05_missing_columns", f"SELECT {REPO} AS repo_id, CASE WHEN repo_no % 2 = 0 THEN 'mask' ELSE 'camera2|mask' END AS missing FROM (SELECT DISTINCT repo_no FROM frames)")
def set_05(s, d):
    have = F.when(F.col("repo_no") % 2 == 0, F.array(F.lit("action"), F.lit("camera2"))).otherwise(F.array(F.lit("action")))
    return named(s, d).select("repo_id", "repo_no").distinct().select("repo_id", F.array_join(F.array_except(F.array(F.lit("action"), F.lit("camera2"), F.lit("mask")), have), "|").alias("missing"))


@query("ts_02_end_spread", f"WITH {LEN} SELECT repo_no, max(sd) AS worst FROM (SELECT repo_no, episode_index, round(stddev_pop(pan) FILTER (WHERE n - frame_index <= 10), 6) AS sd FROM frames JOIN length_ USING (repo_no, episode_index) GROUP BY 1, 2) GROUP BY 1")
def ts_02(s, d):
    e = T.edge_window_stats(frames_of(s, d), "pan", 10)
    return e.groupBy("repo_no").agg(F.max(F.round("end_std", 6)).alias("worst"))


@query("ts_05_extra_frames", """WITH m AS (SELECT repo_no, episode_index, max(frame_index) FILTER (WHERE gripper >= 20 AND lift >= -30) AS l, count(*) AS n FROM frames GROUP BY 1, 2)
 SELECT repo_no, episode_index, least(n, CASE WHEN episode_index % 7 = 0 THEN 50 ELSE 40 END, coalesce(l + 1, n)) AS kept FROM m""")
def ts_05_extra(s, d):
    listed = read(s, d, "events").select((F.col("user_id") % 9).alias("repo_no"), F.col("user_id").alias("episode_index")).distinct().where("episode_index % 7 = 0").withColumn("extra", F.lit(10))
    cap = T.truncation(frames_of(s, d), "last", 5, None).join(listed, EP, "left")
    return cap.select(*EP, F.least("kept", F.lit(40) + F.coalesce("extra", F.lit(0))).alias("kept"))


TICKS = "t AS (SELECT user_id AS rollout, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step, least(value, 60.0) AS v, event_id FROM events)"


def ticks(s, d):
    return frames_of(s, d).selectExpr("episode_index AS rollout", "frame_index AS step", "gripper AS value", "event_id", "pan", "lift")


@query("st_05_motion_gain", f"""WITH RECURSIVE {TICKS}, g AS (SELECT rollout, step, v * 0.5 + 0.5 * (event_id * 37 % 181 - 90) + 2 AS sent FROM t WHERE step = 0
 UNION ALL SELECT t.rollout, t.step, g.sent + least(5, greatest(-5, 0.5 * (t.v * 0.5 + 0.5 * (t.event_id * 37 % 181 - 90) + 2) + 0.5 * g.sent - g.sent)) FROM g JOIN t ON t.rollout = g.rollout AND t.step = g.step + 1)
 SELECT rollout, step, sent FROM g""")
def st_05(s, d):
    # the wanted motion is scaled toward the current state before the guard: gain * value + (1 - gain) * state
    t = ticks(s, d).withColumn("value", F.col("value") * 0.5 + F.col("pan") * 0.5)
    return guards.action_guard(t)


def answered(s, d, limit_ms=10**9):
    t = ticks(s, d).withColumn("t_ms", (F.col("step") * 1000 / 30).cast("long"))
    return t, playback.played(t, playback.Player(8, limit_ms))


@query("st_06_chunk_playback", f"WITH {TICKS} SELECT a.rollout, a.step, b.v + 0.5 * (a.step % 8) AS sent, a.step % 8 = 0 AS ran FROM t a JOIN t b ON b.rollout = a.rollout AND b.step = a.step - a.step % 8")
def st_06(s, d):
    """A chunk of eight is predicted when none is left and played until it is exhausted; a rollout's state is carried over its ticks."""
    return answered(s, d)[1].select("rollout", "step", "sent", "ran")


@query("st_07_first_value", f"WITH {TICKS} SELECT event_id, first_value(v) OVER (PARTITION BY rollout ORDER BY step) AS latched FROM t")
def st_07(s, d):
    t, a = answered(s, d)
    return t.join(a, ["rollout", "step"]).select("event_id", "latched")


@query("st_08_loop_timing", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS ticks, count(*) FILTER (WHERE value > 20) AS overruns FROM events GROUP BY 1")
def st_08(s, d):
    return guards.loop_timing(read(s, d, "events").select("ts", F.col("value").alias("loop_ms")), 20.0, "1 hour")


@query("st_09_log_flattening", "SELECT event_id, CAST((event_id * 37) % 181 AS DOUBLE) - 90 AS pan, least(value, 60.0) AS gripper FROM events")
def st_09(s, d):
    log = frames_of(s, d).select("event_id", F.to_json(F.create_map(F.lit("pan"), "pan", F.lit("gripper"), "gripper")).alias("record"))
    state = F.from_json("record", "map<string,double>")
    return log.withColumn("s", state).select("event_id", F.col("s")["pan"].alias("pan"), F.col("s")["gripper"].alias("gripper"))


@query("st_10_duration_cut", f"WITH {TICKS} SELECT rollout, count(*) AS kept, max(step) AS last FROM t WHERE step * 1000 // 30 < 1500 GROUP BY 1")
def st_10(s, d):
    return answered(s, d, 1500)[1].groupBy("rollout").agg(F.count(F.lit(1)).alias("kept"), F.max("step").alias("last"))


@query("st_11_curriculum", "SELECT event_id, round(1 + 9 * 0.5 * (1 + cos(greatest(0, least(1, (event_id // 100) / 80.0)) * pi())), 6) AS sigma FROM events")
def st_11(s, d):
    from reelbase.functions.names import cosine_decay

    return read(s, d, "events").select("event_id", F.round(cosine_decay(F.expr("event_id div 100"), 80.0, 10.0, 1.0), 6).alias("sigma"))


@query("udf_03_generated_rows", f"WITH {LEN} SELECT repo_no, episode_index, i AS step, round(n * (i + 1) / 6.0, 6) AS at FROM length_, range(0, 5) r(i)")
def udf_03(s, d):
    e = frames_of(s, d).groupBy(*EP).agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("step", F.explode(F.expr("sequence(0L, 4L)"))).select(*EP, "step", F.round(F.col("n") * (F.col("step") + 1) / 6.0, 6).alias("at"))


@query("src_08_rollout_log", f"WITH {TICKS} SELECT rollout, 'v1' AS schema, count(*) AS ticks, max(step) AS last_step FROM t GROUP BY 1")
def src_08(s, d):
    # JSON lines of ticks with one header record per rollout, which is told apart by having no step
    t = ticks(s, d)
    head = t.select("rollout").distinct().select(F.to_json(F.struct("rollout", F.lit("v1").alias("schema"))).alias("value"))
    root = D.fresh_folder(s, "log")
    head.unionByName(t.select(F.to_json(F.struct("rollout", "step")).alias("value"))).write.text(root)
    log = s.read.text(root).select(F.from_json("value", "rollout long, schema string, step long").alias("r")).select("r.*")
    header = log.where("step IS NULL").select("rollout", "schema")
    return log.where("step IS NOT NULL").groupBy("rollout").agg(F.count(F.lit(1)).alias("ticks"), F.max("step").alias("last_step")).join(header, "rollout")


@query("src_14_summaries", "SELECT 'a' AS source, count(*) AS good, CAST(0 AS BIGINT) AS broken FROM nation UNION ALL SELECT 'b', CAST(0 AS BIGINT), count(*) FROM region")
def src_14(s, d):
    # saved summaries of several sources: what does not parse becomes a row of its own
    a = read(s, d, "nation").select(F.lit("a").alias("source"), F.to_json(F.struct("n_nationkey")).alias("value"))
    b = read(s, d, "region").select(F.lit("b").alias("source"), F.lit("{broken").alias("value"))
    parsed = a.unionByName(b).withColumn("r", F.from_json("value", "n_nationkey long, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r._corrupt_record").isNotNull()
    return parsed.groupBy("source").agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("broken"))


__all__ = ["IDENTITY"]
