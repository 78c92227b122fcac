"""Queries of joins, gathers, window operators on pairs of tables, picks and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbase.operators import gathers as G
from reelbase.operators import timeseries as T
from reelbase.operators.ranks import ranked
from reelbase.plans import plans
from reelbase.queries.base import EP, IDENTITY, LEN, SLOT, compiled_round, query, r6
from reelbase.sources import datasets as D
from reelbase.sources.adapters import frames_of, read, repo_names
from reelbase.sources.storage import written_once

W = "(PARTITION BY repo_no, episode_index ORDER BY frame_index)"
INDEX = f"""{LEN}, e AS (SELECT repo_no, episode_index, n, CAST(sum(n) OVER (PARTITION BY repo_no ORDER BY episode_index) - n AS BIGINT) AS f0 FROM length_)"""


def named(s, d):
    f = repo_names(frames_of(s, d))
    return f.withColumns({"identity": F.concat_ws("_", F.split_part("repo_id", F.lit("_"), F.lit(3)), F.split_part("repo_id", F.lit("_"), F.lit(4))), "position": F.split_part("repo_id", F.lit("_"), F.lit(5))})


def lengths(s, d):
    return frames_of(s, d).groupBy(*EP).agg(F.count(F.lit(1)).alias("n"))


@query("jn_01_row_range", f"WITH {INDEX} SELECT repo_no, episode_index, CAST(f0 AS BIGINT) AS from_index, count(*) AS frames, sum(pan) AS pan_sum FROM frames JOIN e USING (repo_no, episode_index) GROUP BY 1, 2, 3")
def jn_01(s, d):
    frames, episodes = T.renumbered(frames_of(s, d), EP, "frame_index", within=["repo_no"])
    e = episodes.select("repo_no", "episode_index", F.col("from_index").alias("dataset_from_index"), F.col("to_index").alias("dataset_to_index"))
    j = G.by_row_range(frames.select("repo_no", "index", "pan"), e, "repo_no")
    return j.groupBy("repo_no", "episode_index", F.col("dataset_from_index").alias("from_index")).agg(F.count(F.lit(1)).alias("frames"), F.sum("pan").alias("pan_sum"))


@query("jn_02_tasks", f"SELECT 'place on ' || {SLOT} AS task, count(*) AS frames FROM frames GROUP BY 1")
def jn_02(s, d):
    tasks = s.createDataFrame([(i, f"place on {p}") for i, p in enumerate(("left", "middle", "right"))], "task_index long, task string")
    return frames_of(s, d).withColumn("task_index", F.col("repo_no") % 3).join(F.broadcast(tasks), "task_index").groupBy("task").agg(F.count(F.lit(1)).alias("frames"))


@query("jn_03_recipe", "SELECT CASE repo_no WHEN 0 THEN 'train' ELSE 'validation' END AS split, repo_no, count(*) AS frames FROM frames WHERE repo_no = 0 OR (repo_no = 2 AND episode_index IN (2, 11, 20)) GROUP BY 1, 2")
def jn_03(s, d):
    recipe = s.createDataFrame([(0, None, "train"), (2, [2, 11, 20], "validation"), (77, None, "train")], "repo_no long, episodes array<long>, split string")
    return G.recipe_frames(frames_of(s, d), recipe).groupBy("split", "repo_no").agg(F.count(F.lit(1)).alias("frames"))


@query("jn_04_pairs", f"""WITH {LEN} SELECT a.repo_no % 3 AS slot, a.episode_index AS a_ep, p.episode_index AS p_ep, row_number() OVER (PARTITION BY a.repo_no % 3 ORDER BY a.episode_index, p.episode_index) - 1 AS pair, a.n + p.n AS length
 FROM length_ a JOIN length_ p ON a.repo_no % 3 = p.repo_no % 3 WHERE a.repo_no < 3 AND p.repo_no BETWEEN 3 AND 5""")
def jn_04(s, d):
    e = lengths(s, d).withColumn("slot", F.col("repo_no") % 3)
    a = e.where("repo_no < 3").selectExpr("slot", "episode_index AS a_ep", "n AS a_n")
    p = e.where("repo_no BETWEEN 3 AND 5").selectExpr("slot", "episode_index AS p_ep", "n AS p_n")
    # the pairs of approaches and placements of a slot are the plan itself; p_ep runs fastest, so a pair's number follows from the places of its two
    a, p = ranked(written_once(a, "approaches"), ["slot"], ["a_ep"], "a_at"), ranked(written_once(p, "placements"), ["slot"], ["p_ep"], "p_at")
    sizes = p.groupBy("slot").agg(F.count(F.lit(1)).alias("of"))
    return G.pairs(a.join(sizes, "slot"), p, ["slot"]).selectExpr("slot", "a_ep", "p_ep", "a_at * of + p_at AS pair", "a_n + p_n AS length")


@query("jn_05_grid", f"""WITH o AS (SELECT DISTINCT {IDENTITY} AS identity, {SLOT} AS position FROM frames WHERE repo_no <> 4),
 g AS (SELECT * FROM (SELECT unnest(['person_a', 'person_b', 'person_d']) AS identity), (SELECT unnest(['left', 'middle', 'right']) AS position))
 SELECT *, 'missing' AS state FROM (SELECT * FROM g EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM o EXCEPT SELECT * FROM g)""")
def jn_05(s, d):
    return G.grid_difference(named(s, d).where("repo_no <> 4"), ["person_a", "person_b", "person_d"], ["left", "middle", "right"])


@query("jn_06_curated", "SELECT n_name, rank, n_regionkey FROM nation JOIN (SELECT 'NATION_7' AS n_name, 0 AS rank UNION ALL SELECT 'NATION_3', 1 UNION ALL SELECT 'NATION_11', 2) USING (n_name)")
def jn_06(s, d):
    return G.curated(read(s, d, "nation"), ["NATION_7", "NATION_3", "NATION_11"], "n_name", F.col("n_nationkey") == 24).select("n_name", "rank", "n_regionkey")


@query("jn_07_audited", f"""WITH m AS (SELECT repo_no, avg(pan) AS pan_mean FROM frames GROUP BY 1), r AS (SELECT repo_no, CASE WHEN count(*) > 0 THEN 'PASS' END AS verdict FROM frames WHERE repo_no % 2 = 0 GROUP BY 1)
 SELECT repo_no, round(pan_mean, 6) AS pan_mean, coalesce(verdict, 'NOT AUDITED') AS verdict FROM m LEFT JOIN r USING (repo_no)""")
def jn_07(s, d):
    f = frames_of(s, d)
    reports = f.where("repo_no % 2 = 0").groupBy("repo_no").agg(F.when(F.count(F.lit(1)) > 0, "PASS").alias("verdict"))
    return f.groupBy("repo_no").agg(F.round(F.avg("pan"), 6).alias("pan_mean")).join(reports, "repo_no", "left").withColumn("verdict", F.coalesce("verdict", F.lit("NOT AUDITED")))


@query("jn_08_live_against_stored", """WITH l AS (SELECT repo_no, avg(wrist_roll) FILTER (WHERE episode_index % 2 = 0) AS live, avg(wrist_roll) AS stored FROM frames GROUP BY 1)
 SELECT repo_no, round(abs(live - stored), 6) AS diff, max(abs(live - stored)) OVER () <= 3 AS gate FROM l""")
def jn_08(s, d):
    f = frames_of(s, d)
    live = f.where("episode_index % 2 = 0").groupBy("repo_no").agg(F.avg("wrist_roll").alias("live"))
    both = f.groupBy("repo_no").agg(F.avg("wrist_roll").alias("stored")).join(live, "repo_no", "left").withColumn("diff", F.abs(F.col("live") - F.col("stored")))
    top = both.agg((F.max("diff") <= 3).alias("gate"))
    return both.crossJoin(F.broadcast(top)).select("repo_no", F.round("diff", 6).alias("diff"), "gate")  # one row


CENTROIDS = {"left": 60.0, "middle": 0.0, "right": -60.0}


@query("jn_10_nearest_within", "SELECT event_id, CASE WHEN abs(pan - 60) <= 20 THEN 'left' WHEN abs(pan) <= 20 THEN 'middle' WHEN abs(pan + 60) <= 20 THEN 'right' END AS slot FROM frames")
def jn_10(s, d):
    return frames_of(s, d).select("event_id", G.nearest_within(F.col("pan"), CENTROIDS, 20.0).alias("slot"))


@query("jn_12_delta_gather", f"""WITH {LEN}, o AS (SELECT repo_no, episode_index, frame_index, event_id, n, CASE WHEN event_id % 10 = 0 THEN 1000 ELSE pan END AS v FROM frames JOIN length_ USING (repo_no, episode_index))
 SELECT a.event_id, sum(b.v * CASE b.frame_index - a.frame_index WHEN 0 THEN 1 ELSE 1 END) AS gathered FROM o a, (SELECT unnest([-5, 0, 3, 200]) AS dd) x, o b
 WHERE b.repo_no = a.repo_no AND b.episode_index = a.episode_index AND b.frame_index = greatest(0, least(a.n - 1, a.frame_index + dd)) GROUP BY 1""")
def jn_12(s, d):
    f = frames_of(s, d)
    overrides = f.where("event_id % 10 = 0").select(*EP, "frame_index", F.lit(1000.0).alias("value"))
    g = G.delta_gather(f, "pan", [-5, 0, 3, 200], overrides)
    return g.select("event_id", F.expr("aggregate(gathered, 0D, (a, x) -> a + x)").alias("gathered"))


@query("jn_13_first_frame", f"""WITH {LEN}, g AS (SELECT f.*, n, first_value(gripper) OVER {W} AS g0, first_value(pan) OVER {W} AS p0 FROM frames f JOIN length_ USING (repo_no, episode_index)),
 h AS (SELECT *, min(CASE WHEN abs(gripper - g0) > 10 THEN frame_index END) OVER (PARTITION BY repo_no, episode_index) AS hit FROM g)
 SELECT event_id, CASE WHEN frame_index <= greatest(floor(n * 0.15), least(floor(n * 0.5), coalesce(hit, floor(n * 0.35)))) THEN pan ELSE p0 END AS pan_seen FROM h""")
def jn_13(s, d):
    return G.first_frame_after(T.grasp_event(frames_of(s, d)), "pan").select("event_id", "pan_seen")


@query("jn_14_rows", f"""WITH p AS (SELECT repo_no, pan, lift, row_number() OVER (PARTITION BY repo_no ORDER BY episode_index, frame_index) AS r FROM frames)
 SELECT a.repo_no AS repo_a, b.repo_no AS repo_b, count(*) AS rows_compared, count(*) FILTER (WHERE a.pan = b.pan AND a.lift = b.lift) AS rows_equal, count(*) FILTER (WHERE abs(a.pan - b.pan) <= 1e-6 AND abs(a.lift - b.lift) <= 1e-6) AS rows_close,
 max(greatest(abs(a.pan - b.pan), abs(a.lift - b.lift))) AS max_diff, round(sum(abs(a.pan - b.pan) + abs(a.lift - b.lift)) / (2 * count(*)), 6) AS mean_diff, round(avg(sqrt((a.pan - b.pan) ** 2 + (a.lift - b.lift) ** 2)), 6) AS mean_l2
 FROM p a JOIN p b ON a.r = b.r AND a.repo_no % 3 = b.repo_no % 3 AND a.repo_no < b.repo_no GROUP BY 1, 2""")
def jn_14(s, d):
    return r6(G.compared_rows(frames_of(s, d), ["pan", "lift"]), "mean_diff", "mean_l2")


@query("jn_16_round_robin", f"""WITH {LEN}, e AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS i, count(*) OVER () AS n FROM length_ WHERE repo_no = 1),
 c AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) SELECT p_partkey, episode_index FROM c JOIN e ON c.i % e.n = e.i""")
def jn_16(s, d):
    # configs are numbered by their own key, so shards agree
    sources = written_once(lengths(s, d).where("repo_no = 1").select("episode_index"), "sources")
    slots = ranked(sources, [], ["episode_index"], "slot")
    n = F.broadcast(sources.agg(F.count(F.lit(1)).alias("n")))  # one row
    configs = ranked(read(s, d, "part").select("p_partkey"), [], ["p_partkey"], "index")
    return configs.crossJoin(n).withColumn("slot", F.col("index") % F.col("n")).join(slots, "slot").select("p_partkey", "episode_index")


@query("jn_17_copy_check", "SELECT count(*) AS compared, count(*) FILTER (WHERE event_id % 7 = 0 AND event_id % 2 = 0) AS differing FROM events WHERE event_id % 7 = 0")
def jn_17(s, d):
    local = read(s, d, "events").select("event_id", "value")
    remote = local.withColumn("other", F.col("value") + F.when(F.col("event_id") % 2 == 0, 0.5).otherwise(0.0)).drop("value")
    j = local.where("event_id % 7 = 0").join(remote, "event_id")
    return j.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.abs(F.col("value") - F.col("other")) > 1e-6).alias("differing"))


@query("jn_18_layout", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'T' ELSE CASE WHEN p_partkey % 2 = 1 THEN 'B' ELSE 'A' END END AS left,
 CASE p_partkey % 3 WHEN 1 THEN 'T' WHEN 0 THEN CASE WHEN p_partkey % 2 = 1 THEN 'B' ELSE 'A' END ELSE CASE WHEN p_partkey % 2 = 1 THEN 'A' ELSE 'B' END END AS middle,
 CASE p_partkey % 3 WHEN 2 THEN 'T' ELSE CASE WHEN p_partkey % 2 = 1 THEN 'A' ELSE 'B' END END AS right FROM part""")
def jn_18(s, d):
    p = read(s, d, "part").select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("slot"), (F.col("p_partkey") % 2 == 1).alias("swap"))
    others = F.when(F.col("swap"), F.array(F.lit("B"), F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    layout = F.array_insert(others, F.col("slot") + 1, F.lit("T"))
    return p.withColumn("x", layout).select("p_partkey", *[F.element_at("x", i + 1).alias(n) for i, n in enumerate(("left", "middle", "right"))])


@query("jn_19_attached", f"WITH {LEN} SELECT repo_no, episode_index, n, n % 2 = 0 AS pass, row_number() OVER (PARTITION BY repo_no ORDER BY n % 2, episode_index) AS place FROM length_")
def jn_19(s, d):
    # the stored report has a record for each episode; the recomputed lengths meet it by episode
    e, root = written_once(lengths(s, d), "lengths"), D.fresh_folder(s, "stored")
    e.selectExpr(*EP, "n % 2 = 0 AS pass").write.json(root)
    stored = s.read.schema("repo_no long, episode_index long, pass boolean").json(root)
    both = e.join(stored, EP, "left").withColumn("failed", ~F.col("pass"))
    return ranked(written_once(both, "attached"), ["repo_no"], ["failed", "episode_index"], "place").selectExpr(*EP, "n", "pass", "place + 1 AS place")


@query("ts_08_overrides", f"SELECT event_id, greatest(gripper, 55) AS gripper FROM frames WHERE gripper >= 20 AND gripper < 55 - 1e-6")
def ts_08(s, d):
    f = frames_of(s, d)
    after = f.withColumn("gripper", T.repaired_gripper(F.col("gripper")))
    o = G.sparse_overrides(f, after, ["pan", "gripper"])
    return o.join(f.select(*EP, "frame_index", "event_id"), [*EP, "frame_index"]).select("event_id", F.element_at("vector", 2).alias("gripper"))


@query("ts_11_differences", f"""WITH x AS (SELECT repo_no, episode_index, pan - lag(pan) OVER {W} AS d1, pan - 2 * lag(pan) OVER {W} + lag(pan, 2) OVER {W} AS d2 FROM frames)
 SELECT repo_no, episode_index, round(avg(abs(d1)), 6) AS step_mean, round(quantile_cont(abs(d1), 0.95), 6) AS step_p95, round(quantile_cont(abs(d2), 0.95), 6) AS bend_p95 FROM x GROUP BY 1, 2""")
def ts_11(s, d):
    w = T.ordered()
    one, two = F.lag("pan").over(w), F.lag("pan", 2).over(w)
    x = frames_of(s, d).withColumns({"d1": F.abs(F.col("pan") - one), "d2": F.abs(F.col("pan") - 2 * one + two)})
    return r6(x.groupBy(*EP).agg(F.avg("d1").alias("step_mean"), F.percentile("d1", F.lit(0.95)).alias("step_p95"), F.percentile("d2", F.lit(0.95)).alias("bend_p95")), "step_mean", "step_p95", "bend_p95")


@query("ts_14_wrong_side", f"""WITH p AS (SELECT repo_no, episode_index, max(pan) AS hi, min(pan) AS lo FROM frames GROUP BY 1, 2)
 SELECT repo_no, episode_index, CASE repo_no % 3 WHEN 0 THEN greatest(0, -lo) / 60.0 WHEN 2 THEN greatest(0, hi) / 60.0 END AS wrong_side FROM p""")
def ts_14(s, d):
    p = frames_of(s, d).groupBy(*EP).agg(F.max("pan").alias("hi"), F.min("pan").alias("lo"))
    slot = F.col("repo_no") % 3
    # left lies at +60, right at -60: the excursion to the other side as a share of that distance
    return p.select(*EP, F.when(slot == 0, F.greatest(F.lit(0.0), -F.col("lo")) / 60.0).when(slot == 2, F.greatest(F.lit(0.0), F.col("hi")) / 60.0).alias("wrong_side"))


@query("ts_15_run_end", f"WITH {INDEX} SELECT event_id, CAST(f0 + n AS BIGINT) AS run_end FROM frames JOIN e USING (repo_no, episode_index)")
def ts_15(s, d):
    return G.episode_end(frames_of(s, d)).select("event_id", F.col("run_end").cast("long").alias("run_end"))


ENDS = f"""b AS (SELECT repo_no, episode_index, arg_min(pan, frame_index) AS p0, arg_min(lift, frame_index) AS l0, arg_max(pan, frame_index) AS p1, arg_max(lift, frame_index) AS l1 FROM frames GROUP BY 1, 2)"""


@query("ts_17_bridge", f"""WITH {ENDS} SELECT a.repo_no % 3 AS slot, a.episode_index AS a_ep, p.episode_index AS b_ep, i AS step, round(a.p1 + (p.p0 - a.p1) * (i + 1) / 6.0, 6) AS pan
 FROM b a JOIN b p ON a.repo_no % 3 = p.repo_no % 3, range(0, 5) r(i) WHERE a.repo_no < 3 AND p.repo_no BETWEEN 3 AND 5""")
def ts_17(s, d):
    f = frames_of(s, d).withColumn("slot", F.col("repo_no") % 3)
    last = f.where("repo_no < 3").groupBy("slot", "episode_index").agg(F.array(F.max_by("pan", "frame_index")).alias("x")).withColumnRenamed("episode_index", "a_ep")
    first = f.where("repo_no BETWEEN 3 AND 5").groupBy("slot", "episode_index").agg(F.array(F.min_by("pan", "frame_index")).alias("y")).withColumnRenamed("episode_index", "b_ep")
    between = G.bridge(G.pairs(last, first, ["slot"]), 5, dims=1)
    return between.select("slot", "a_ep", "b_ep", F.col("step").cast("long").alias("step"), compiled_round(F.col("vector")[0], 6).alias("pan"))


@query("ts_19_seams", f"""WITH {ENDS} SELECT a.repo_no % 3 AS slot, a.episode_index AS a_ep, p.episode_index AS b_ep, round(sqrt((a.p1 - p.p0) ** 2 + (a.l1 - p.l0) ** 2), 6) AS distance
 FROM b a JOIN b p ON a.repo_no % 3 = p.repo_no % 3 WHERE a.repo_no < 3 AND p.repo_no BETWEEN 3 AND 5""")
def ts_19(s, d):
    f = frames_of(s, d).withColumn("slot", F.col("repo_no") % 3)
    seams = G.seam_distance(f.where("repo_no < 3"), f.where("repo_no BETWEEN 3 AND 5"), ["pan", "lift"])
    return seams.withColumn("distance", compiled_round(F.col("distance"), 6))


@query("ts_18_segments", f"""WITH {LEN}, p AS (SELECT a.repo_no % 3 AS slot, a.episode_index AS a_ep, p.episode_index AS p_ep, a.n + 5 + p.n AS length FROM length_ a JOIN length_ p ON a.repo_no % 3 = p.repo_no % 3 WHERE a.repo_no < 3 AND p.repo_no BETWEEN 3 AND 5)
 SELECT slot, a_ep, p_ep, length, row_number() OVER w - 1 AS episode_no, CAST(sum(length) OVER w - length AS BIGINT) AS from_index FROM p WINDOW w AS (ORDER BY slot, a_ep, p_ep)""")
def ts_18(s, d):
    f = frames_of(s, d).withColumn("slot", F.col("repo_no") % 3)
    # each side is numbered by itself; what a pair begins at follows from the places of its two
    side = lambda where, ep: T.renumbered(f.where(where), ["slot", "episode_index"], "frame_index", within=["slot"])[1].withColumnRenamed("episode_index", ep)
    return plans.pair_index(side("repo_no < 3", "a_ep"), side("repo_no BETWEEN 3 AND 5", "p_ep"), 5)


@query("ts_20_contiguity", "SELECT DISTINCT repo_no, true AS tiled, true AS lengths, true AS numbered FROM frames")
def ts_20(s, d):
    f = frames_of(s, d)
    return G.contiguity(T.renumbered(f, EP, "frame_index", within=["repo_no"])[1], f)


@query("ts_21_flag", f"""WITH {LEN} SELECT repo_no, episode_index, CAST(1 AS BIGINT) AS changes, true AS once FROM length_ WHERE n > 2""")
def ts_21(s, d):
    f = T.with_length(T.grasp_event(frames_of(s, d))).where("n > 2")
    return G.flips_once(f, "pregrasp", "grasp")


@query("ts_22_trajectories", f"""WITH x AS (SELECT repo_no, episode_index, frame_index, gripper, pan, coalesce(lag(pan) OVER {W}, pan) AS q FROM frames),
 y AS (SELECT *, arg_min(frame_index, gripper * 100000 + frame_index) OVER (PARTITION BY repo_no, episode_index) AS low FROM x)
 SELECT repo_no, episode_index, round(avg(abs(pan - q)), 6) AS mae, max(pan) - min(pan) AS truth_range, max(q) - min(q) AS predicted_range,
 round(CASE WHEN stddev_pop(pan) < 1e-9 OR stddev_pop(q) < 1e-9 THEN 0 ELSE corr(pan, q) END, 6) AS r, round(avg(abs(pan - q)) FILTER (WHERE frame_index > low), 6) AS mae_after_grasp FROM y GROUP BY 1, 2""")
def ts_22(s, d):
    f = frames_of(s, d)
    f = f.withColumn("q", F.coalesce(F.lag("pan").over(T.ordered()), F.col("pan")))
    return r6(G.trajectory_errors(f, "pan", "q"), "mae", "r", "mae_after_grasp")


@query("ts_23_extreme_frames", "SELECT repo_no, max(pan) AS pan, arg_max(event_id, pan * 10000000 - event_id) AS event_id FROM frames WHERE frame_index % 5 = 0 GROUP BY 1")
def ts_23(s, d):
    f = frames_of(s, d).where("frame_index % 5 = 0")
    return f.groupBy("repo_no").agg(F.max("pan").alias("pan"), F.max_by("event_id", F.struct("pan", -F.col("event_id"))).alias("event_id"))


@query("ts_24_bifurcation", f"""WITH {LEN}, k AS (SELECT repo_no % 3 AS slot, fr, avg(pan) AS m FROM frames JOIN length_ USING (repo_no, episode_index), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS fr) WHERE frame_index = CAST(round_even(fr * (n - 1), 0) AS BIGINT) GROUP BY 1, 2),
 s AS (SELECT fr, max(m) - min(m) AS spread FROM k GROUP BY 1) SELECT CAST(fr AS DOUBLE) AS fraction, round(spread, 6) AS spread, spread = max(spread) OVER () AS bifurcation FROM s""")
def ts_24(s, d):
    shares = F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    f = T.with_length(frames_of(s, d)).withColumn("fraction", shares).where("frame_index = cast(bround(fraction * (n - 1)) as bigint)")
    m = f.groupBy((F.col("repo_no") % 3).alias("slot"), "fraction").agg(F.avg("pan").alias("m")).groupBy("fraction").agg((F.max("m") - F.min("m")).alias("spread"))
    # five rows
    return m.selectExpr("fraction", "round(spread, 6) AS spread", "spread = max(spread) OVER () AS bifurcation")


@query("smp_01_fractions", f"""WITH {LEN} SELECT DISTINCT repo_no, episode_index, CAST(floor((n - 1) * f) AS BIGINT) AS frame_index, CASE WHEN f >= 0.75 THEN 'final' ELSE 'early' END AS phase FROM length_, (SELECT unnest([0.5, 0.88]) AS f)""")
def smp_01(s, d):
    return G.fractional_picks(lengths(s, d), 2).select(*EP, F.col("frame_index").cast("long").alias("frame_index"), "phase")


@query("smp_02_even_cap", """WITH p AS (SELECT event_id, repo_no, row_number() OVER (PARTITION BY repo_no ORDER BY episode_index, frame_index) - 1 AS r, count(*) OVER (PARTITION BY repo_no) AS n FROM frames)
 SELECT DISTINCT repo_no, event_id FROM p, range(0, 20) k(i) WHERE n <= 20 OR r = round_even(i * (n - 1) / 19.0, 0)""")
def smp_02(s, d):
    return G.even_positions(frames_of(s, d), ["repo_no"], ["episode_index", "frame_index"], 20).select("repo_no", "event_id")


@query("smp_03_even_sample", """WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n, l_returnflag FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem))
 SELECT DISTINCT l_returnflag, l_orderkey, l_linenumber FROM p, range(0, 50) k(i) WHERE n <= 50 OR r = round_even(i * (n - 1) / 49.0, 0)""")
def smp_03(s, d):
    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    return G.even_positions(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber"], 50).select("l_returnflag", "l_orderkey", "l_linenumber")


@query("smp_04_final_phase", f"""WITH {LEN}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_no ORDER BY episode_index) AS k FROM length_)
 SELECT 'final' AS pick, repo_no, episode_index, CAST(floor(0.95 * (n - 1)) AS BIGINT) AS frame_index FROM r WHERE k <= 3
 UNION ALL SELECT 'sequence', repo_no, episode_index, CAST(i AS BIGINT) FROM r, range(0, 1000) x(i) WHERE k = 1 AND i >= floor(0.25 * n) AND i < least(n, floor(0.25 * n) + 12)""")
def smp_04(s, d):
    """Per repo: the frame at 95 % of its first three episodes, and twelve frames in a row from a quarter of the first one."""
    e = lengths(s, d).withColumn("k", F.expr("row_number() OVER (PARTITION BY repo_no ORDER BY episode_index)")).where("k <= 3")
    final = e.select(F.lit("final").alias("pick"), *EP, F.floor(0.95 * (F.col("n") - 1)).cast("long").alias("frame_index"))
    return final.unionByName(G.window_from(e.where("k = 1"), 12).select(F.lit("sequence").alias("pick"), *EP, F.col("frame_index").cast("long").alias("frame_index")))


@query("smp_05_strides", f"WITH {LEN} SELECT DISTINCT repo_no, episode_index, CAST(floor(i * (n - 1) / 7) AS BIGINT) AS frame_index FROM length_, range(0, 8) r(i) WHERE episode_index % 4 = 0")
def smp_05(s, d):
    return G.strided_frames(lengths(s, d).where("episode_index % 4 = 0"), 8).select(*EP, F.col("frame_index").cast("long").alias("frame_index"))


@query("smp_08_balanced", "SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('5:pos:' || c_custkey), c_custkey) - 1) % 3 AS INT) AS position FROM customer")
def smp_08(s, d):
    c = read(s, d, "customer").withColumn("o", F.md5(F.concat(F.lit("5:pos:"), F.col("c_custkey").cast("string"))))
    return ranked(c, ["c_nationkey"], ["o", "c_custkey"]).selectExpr("c_custkey", "cast(rank % 3 as int) AS position")


@query("smp_10_prompts", f"""WITH p AS (SELECT n.n_nationkey AS own, o.n_nationkey AS other, row_number() OVER (PARTITION BY n.n_nationkey ORDER BY md5('3:' || n.n_nationkey || ':' || o.n_nationkey), o.n_nationkey) AS r FROM nation n JOIN nation o ON n.n_regionkey = o.n_regionkey AND n.n_nationkey <> o.n_nationkey)
 SELECT own, other FROM p WHERE r <= 2 UNION ALL SELECT n_nationkey, n_nationkey FROM nation""")
def smp_10(s, d):
    n = read(s, d, "nation").select("n_nationkey", "n_regionkey")
    o = n.withColumnRenamed("n_nationkey", "other")
    order = F.md5(F.concat_ws(":", F.lit("3"), F.col("own").cast("string"), F.col("other").cast("string")))
    pairs = n.withColumnRenamed("n_nationkey", "own").join(o, "n_regionkey").where("own <> other").withColumn("o", order)
    two = pairs.withColumn("r", F.expr("row_number() OVER (PARTITION BY own ORDER BY o, other)")).where("r <= 2").select("own", "other")
    return two.unionByName(n.selectExpr("n_nationkey AS own", "n_nationkey AS other"))


@query("smp_11_shards", "SELECT l_orderkey, l_linenumber, CAST(ntile(7) OVER (ORDER BY l_orderkey * 10 + l_linenumber) - 1 AS INT) AS shard FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def smp_11(s, d):
    from reelbase.operators import mix

    rows = read(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return mix.even_shards(rows, "k", 7).select("l_orderkey", "l_linenumber", "shard")


@query("smp_13_random_frames", "SELECT repo_no, event_id FROM (SELECT *, row_number() OVER (PARTITION BY repo_no ORDER BY md5('9:' || event_id), event_id) AS r FROM frames) WHERE r <= 12")
def smp_13(s, d):
    f = frames_of(s, d).withColumn("o", F.md5(F.concat(F.lit("9:"), F.col("event_id").cast("string"))))
    return f.withColumn("r", F.expr("row_number() OVER (PARTITION BY repo_no ORDER BY o, event_id)")).where("r <= 12").select("repo_no", "event_id")


@query("flt_01_exclude_list", "SELECT repo_no, count(*) AS frames FROM frames WHERE NOT (repo_no = 0 AND episode_index IN (0, 9)) GROUP BY 1")
def flt_01(s, d):
    from reelbase.operators import mix

    drop = mix.parsed_filter(s, "0:0,9").select(F.col("repo").cast("long").alias("repo_no"), F.col("episode").alias("episode_index"))
    return mix.kept_episodes(frames_of(s, d), drop=F.broadcast(drop)).groupBy("repo_no").agg(F.count(F.lit(1)).alias("frames"))


@query("flt_02_identity_lists", f"SELECT {IDENTITY} AS identity, count(*) AS frames FROM frames WHERE (repo_no // 3 = 0 AND episode_index < 50) OR (repo_no // 3 = 1 AND episode_index BETWEEN 20 AND 60) GROUP BY 1")
def flt_02(s, d):
    lists = s.createDataFrame([("person_a", e) for e in range(50)] + [("person_b", e) for e in range(20, 61)], "identity string, episode_index long")
    return named(s, d).join(F.broadcast(lists), ["identity", "episode_index"], "left_semi").groupBy("identity").agg(F.count(F.lit(1)).alias("frames"))


@query("flt_03_synthetic_cap", "SELECT repo_no, count(*) AS frames FROM frames WHERE frame_index < CASE WHEN repo_no >= 6 THEN least(40, 25) ELSE 40 END AND (repo_no < 6 OR episode_index < 60) GROUP BY 1")
def flt_03(s, d):
    cap = F.when(F.col("repo_no") >= 6, F.least(F.lit(40), F.lit(25))).otherwise(40)
    return frames_of(s, d).where((F.col("frame_index") < cap) & ((F.col("repo_no") < 6) | (F.col("episode_index") < 60))).groupBy("repo_no").agg(F.count(F.lit(1)).alias("frames"))


@query("flt_08_phase_mask", f"""WITH {LEN} SELECT repo_no, round(avg(pan) FILTER (WHERE frame_index >= floor(0.75 * (n - 1))), 6) AS final_mean, count(*) FILTER (WHERE repo_no % 4 <> 3 AND frame_index <= n * 0.3) AS masked FROM frames JOIN length_ USING (repo_no, episode_index) GROUP BY 1""")
def flt_08(s, d):
    f = T.with_length(frames_of(s, d)).withColumn("label", F.when(F.col("repo_no") % 4 == 3, -100).otherwise(1))
    return f.groupBy("repo_no").agg(F.round(F.expr("avg(pan) FILTER (WHERE frame_index >= floor(0.75 * (n - 1)))"), 6).alias("final_mean"), F.expr("count(*) FILTER (WHERE label <> -100 AND frame_index <= n * 0.3)").alias("masked"))


@query("flt_09_prefix", "SELECT p_name, count(*) AS offences FROM part WHERE NOT starts_with(p_name, 'small') GROUP BY 1")
def flt_09(s, d):
    return read(s, d, "part").where(~F.col("p_name").startswith("small")).groupBy("p_name").agg(F.count(F.lit(1)).alias("offences"))


@query("flt_10_globs", "SELECT p_brand, count(*) AS n FROM part WHERE regexp_matches(p_brand, '^Brand#1.*$') AND NOT regexp_matches(p_brand, '^.*7$') GROUP BY 1")
def flt_10(s, d):
    return read(s, d, "part").where(F.col("p_brand").rlike("^Brand#1.*$") & ~F.col("p_brand").rlike("^.*7$")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("flt_11_targets", "SELECT n_name, n_regionkey FROM nation WHERE n_name IN ('NATION_1', 'NATION_4')")
def flt_11(s, d):
    names = [x.strip() for x in "NATION_1, NATION_4".split(",")]
    return G.curated(read(s, d, "nation"), names, "n_name", F.lit(False)).select("n_name", "n_regionkey")


@query("jn_09_nearest_centroid", "SELECT event_id, CASE WHEN abs(pan - 60) <= abs(pan) AND abs(pan - 60) <= abs(pan + 60) THEN 'left' WHEN abs(pan + 60) <= abs(pan) THEN 'right' ELSE 'middle' END AS slot FROM frames")
def jn_09(s, d):
    from reelbase.functions.names import nearest

    # ties: left, right, middle
    return frames_of(s, d).select("event_id", nearest(F.col("pan"), {"left": 60.0, "right": -60.0, "middle": 0.0}).alias("slot"))


@query("prj_05_slot_labels", f"SELECT repo_no, CASE WHEN repo_no < 6 THEN CAST(repo_no % 3 AS INT) ELSE -100 END AS label FROM (SELECT DISTINCT repo_no FROM frames)")
def prj_05(s, d):
    from reelbase.functions.names import slot_label

    r = frames_of(s, d).select("repo_no").distinct()
    word = F.when(F.col("repo_no") < 6, F.element_at(F.array(F.lit("left"), F.lit("middle"), F.lit("right")), (F.col("repo_no") % 3).cast("int") + 1))
    return r.select("repo_no", slot_label(word).alias("label"))


@query("udf_01_row_functions", f"SELECT event_id, 'go ' || {SLOT} AS task, pan * 2 AS pan FROM frames")
def udf_01(s, d):
    # what a user injects per row are functions from columns to columns, so that they run inside the plan
    injected = {"task": lambda r: F.concat(F.lit("go "), r["position"]), "pan": lambda r: r["pan"] * 2}
    f = named(s, d)
    return f.select("event_id", *[g(f).alias(k) for k, g in injected.items()])


@query("udf_02_grouped_function", f"SELECT repo_no, episode_index, frame_index, max(pan) OVER {W} AS highest FROM frames")
def udf_02(s, d):
    import pandas as pd

    def run(batches):
        # sorted batches; only the running value of the episode at hand is carried, so an episode of any length fits
        own = top = None
        for b in batches:
            out = []
            for repo, episode, pan in zip(b["repo_no"], b["episode_index"], b["pan"], strict=True):
                top = pan if (repo, episode) != own else max(top, pan)
                own = (repo, episode)
                out.append(top)
            yield pd.DataFrame({"repo_no": b["repo_no"], "episode_index": b["episode_index"], "frame_index": b["frame_index"], "highest": out})

    f = frames_of(s, d).select(*EP, "frame_index", "pan").repartition(*EP).sortWithinPartitions(*EP, "frame_index")
    return f.mapInPandas(run, "repo_no long, episode_index long, frame_index long, highest double")


@query("udf_04_merged_aggregate", "SELECT round(avg(gripper), 6) AS mean, round(stddev_pop(gripper), 6) AS std, count(*) AS count FROM frames")
def udf_04(s, d):
    from reelbase.operators import stats

    parts = stats.dimension_stats(frames_of(s, d), EP, ["gripper"])
    return r6(stats.merged_stats(parts, ["dim"]).select("mean", "std", F.col("count").cast("long").alias("count")), "mean", "std")
