"""Queries of single operators: time series, statistics, sampling, names, scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbase.functions import names as N
from reelbase.operators import mix, stats
from reelbase.operators import timeseries as T
from reelbase.plans import audit
from reelbase.queries.base import EP, LEN, query, r6
from reelbase.sources.adapters import FPS, JOINTS, frames_of, read, repo_names
from reelbase.sources.storage import written_once
from reelbase.streaming import guards

@query("ts_01_edge_windows", f"""WITH {LEN} SELECT f.repo_no, f.episode_index, round(avg(pan) FILTER (WHERE frame_index < 10), 6) AS start_mean,
 round(avg(pan) FILTER (WHERE n - frame_index <= 10), 6) AS end_mean, round(stddev_pop(pan) FILTER (WHERE n - frame_index <= 10), 6) AS end_std
 FROM frames f JOIN length_ USING (repo_no, episode_index) GROUP BY 1, 2""")
def ts_01(s, d):
    return r6(T.edge_window_stats(frames_of(s, d), "pan", 10), "start_mean", "end_mean", "end_std")


@query("ts_03_signed_peak", """SELECT repo_no, episode_index, CASE WHEN abs(max(pan)) >= abs(min(pan)) THEN max(pan) ELSE min(pan) END AS peak,
 arg_max(frame_index, abs(pan) * 100000 - frame_index) AS peak_frame FROM frames GROUP BY 1, 2""")
def ts_03(s, d):
    return T.signed_peak(frames_of(s, d), "pan")


@query("ts_04_placement_match", """SELECT repo_no, episode_index, min(frame_index) FILTER (WHERE gripper >= 20 AND lift >= -30) AS first_match,
 max(frame_index) FILTER (WHERE gripper >= 20 AND lift >= -30) AS last_match, count(*) AS length FROM frames GROUP BY 1, 2""")
def ts_04(s, d):
    return T.placement_match(frames_of(s, d))


TRUNC = """m AS (SELECT repo_no, episode_index, min(frame_index) FILTER (WHERE gripper >= 20 AND lift >= -30) AS f, max(frame_index) FILTER (WHERE gripper >= 20 AND lift >= -30) AS l, count(*) AS n FROM frames GROUP BY 1, 2),
 t AS (SELECT repo_no, episode_index, n, CASE WHEN l IS NULL THEN least(40, n) ELSE least({end}, least(40, n)) END AS kept FROM m)"""


@query("ts_05_truncation_last", f"WITH {TRUNC.format(end='l + 1')} SELECT repo_no, episode_index, n AS length, kept FROM t")
def ts_05_last(s, d):
    return T.truncation(frames_of(s, d), "last", 5, 40).select(*EP, "length", "kept")


@query("ts_05_truncation_first", f"WITH {TRUNC.format(end='f + 5')} SELECT repo_no, episode_index, n AS length, kept FROM t")
def ts_05_first(s, d):
    return T.truncation(frames_of(s, d), "first", 5, 40).select(*EP, "length", "kept")


@query("ts_06_gripper_repair", "SELECT repo_no, episode_index, count(*) FILTER (WHERE gripper >= 20 AND gripper < 55) AS changed, round(sum(CASE WHEN gripper >= 20 THEN greatest(gripper, 55) ELSE gripper END), 4) AS total FROM frames GROUP BY 1, 2")
def ts_06(s, d):
    f = frames_of(s, d).withColumn("g", T.repaired_gripper(F.col("gripper")))
    return f.groupBy(*EP).agg(F.count_if(F.abs(F.col("g") - F.col("gripper")) > 1e-6).alias("changed"), F.round(F.sum("g"), 4).alias("total"))


@query("ts_07_smoothing", """WITH x AS (SELECT repo_no, episode_index, frame_index, pan, coalesce(lag(pan) OVER w, pan) AS a, coalesce(lead(pan) OVER w, pan) AS b, count(*) OVER (PARTITION BY repo_no, episode_index) AS n
 FROM frames WINDOW w AS (PARTITION BY repo_no, episode_index ORDER BY frame_index)) SELECT repo_no, episode_index, frame_index, round(CASE WHEN n < 3 THEN pan ELSE (a + pan + b) / 3 END, 6) AS pan_s FROM x""")
def ts_07(s, d):
    return r6(T.smoothed(frames_of(s, d), ["pan"], 3).select(*EP, "frame_index", "pan_s"), "pan_s")


@query("ts_09_lag_p95", """WITH x AS (SELECT repo_no, episode_index, abs(pan - coalesce(lag(pan) OVER (PARTITION BY repo_no, episode_index ORDER BY frame_index), pan)) AS e FROM frames)
 SELECT repo_no, episode_index, round(quantile_cont(e, 0.95), 6) AS lag_p95 FROM x GROUP BY 1, 2""")
def ts_09(s, d):
    return r6(T.lag_error(frames_of(s, d), "pan"), "lag_p95")


@query("ts_10_jerk", """WITH x AS (SELECT repo_no, episode_index, (pan - 2 * lag(pan, 1) OVER w + lag(pan, 2) OVER w) * 900 AS a, (lift - 2 * lag(lift, 1) OVER w + lag(lift, 2) OVER w) * 900 AS b
 FROM frames WINDOW w AS (PARTITION BY repo_no, episode_index ORDER BY frame_index)) SELECT repo_no, episode_index, round(coalesce(quantile_cont(sqrt(a * a + b * b), 0.99), 0), 4) AS jerk_p99 FROM x GROUP BY 1, 2""")
def ts_10(s, d):
    return T.jerk(frames_of(s, d), ["pan", "lift"], FPS).withColumn("jerk_p99", F.round("jerk_p99", 4))


@query("ts_12_fractional_windows", f"""WITH {LEN} SELECT f.repo_no, f.episode_index, max(gripper) FILTER (WHERE frame_index < greatest(1, floor(n * 0.25))) AS early_max,
 round(quantile_cont(gripper, 0.5) FILTER (WHERE frame_index >= floor(n * 0.75)), 6) AS late_median, round(min(frame_index) FILTER (WHERE gripper >= 20) / 30.0, 6) AS first_cross_s FROM frames f JOIN length_ USING (repo_no, episode_index) GROUP BY 1, 2""")
def ts_12(s, d):
    return r6(T.fractional_windows(frames_of(s, d), "gripper", FPS), "late_median", "first_cross_s")


@query("ts_12_late_windows", f"""WITH {LEN} SELECT f.repo_no, f.episode_index, round(quantile_cont(gripper, 0.9) FILTER (WHERE frame_index >= floor(n * 0.75)), 6) AS late_q90, round(quantile_cont(gripper, 0.99) FILTER (WHERE frame_index >= floor(n * 0.75)), 6) AS late_q99,
 round(avg(gripper) FILTER (WHERE n - frame_index <= 30), 6) AS last_second_mean, round(max(lift) - avg(lift) FILTER (WHERE frame_index < 30), 6) AS extension FROM frames f JOIN length_ USING (repo_no, episode_index) GROUP BY 1, 2""")
def ts_12_late(s, d):
    return r6(T.late_windows(frames_of(s, d), "gripper", "lift", FPS), "late_q90", "late_q99", "last_second_mean", "extension")


@query("ts_13_grasp_event", f"""WITH {LEN}, g AS (SELECT repo_no, episode_index, gripper AS g0 FROM frames WHERE frame_index = 0),
 h AS (SELECT repo_no, episode_index, n, min(frame_index) FILTER (WHERE abs(gripper - g0) > 10) AS hit FROM frames JOIN g USING (repo_no, episode_index) JOIN length_ USING (repo_no, episode_index) GROUP BY 1, 2, 3)
 SELECT repo_no, episode_index, CAST(greatest(floor(n * 0.15), least(floor(n * 0.5), coalesce(hit, floor(n * 0.35)))) AS BIGINT) AS grasp, CAST(greatest(floor(n * 0.15), least(floor(n * 0.5), coalesce(hit, floor(n * 0.35)))) AS BIGINT) + 1 AS pre_frames FROM h""")
def ts_13(s, d):
    return T.grasp_event(frames_of(s, d)).groupBy(*EP).agg(F.max("grasp").alias("grasp"), F.count_if("pregrasp").alias("pre_frames"))


@query("ts_16_renumber", """WITH e AS (SELECT l_orderkey, count(*) AS length FROM lineitem GROUP BY 1) SELECT l_orderkey, length, row_number() OVER (ORDER BY l_orderkey) - 1 AS episode_no,
 CAST(sum(length) OVER (ORDER BY l_orderkey) - length AS BIGINT) AS from_index, CAST(sum(length) OVER (ORDER BY l_orderkey) AS BIGINT) AS to_index FROM e""")
def ts_16(s, d):
    return T.renumbered(read(s, d, "lineitem"), ["l_orderkey"], "l_linenumber")[1].drop("from_time", "to_time")


def _agg01(keys: str) -> str:
    parts = " UNION ALL ".join(f"SELECT repo_no, episode_index, '{j}' AS dim, {j} AS v FROM frames" for j in JOINTS)
    q = ", ".join(f"round(quantile_cont(v, {p}), 6) AS q{int(p * 100):02d}" for p in stats.QUANTILES)
    return f"WITH u AS ({parts}) SELECT {keys}, dim, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS count, {q} FROM u GROUP BY {keys}, dim"


STAT = ["mean", "std", "q01", "q10", "q50", "q90", "q99"]


@query("agg_01_episode_stats", _agg01("repo_no, episode_index"))
def agg_01(s, d):
    return r6(stats.dimension_stats(frames_of(s, d), EP, list(JOINTS)), *STAT)


@query("agg_02_repaired_stats", f"""WITH m AS (SELECT repo_no, episode_index, max(frame_index) FILTER (WHERE gripper >= 20 AND lift >= -30) AS l FROM frames GROUP BY 1, 2),
 k AS (SELECT f.repo_no, CASE WHEN gripper >= 20 THEN greatest(gripper, 55) ELSE gripper END AS g FROM frames f JOIN m USING (repo_no, episode_index) WHERE frame_index < least(coalesce(l + 1, 40), 40))
 SELECT repo_no, min(g) AS min, max(g) AS max, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std, count(*) AS count, round(quantile_cont(g, 0.5), 6) AS q50 FROM k GROUP BY 1""")
def agg_02(s, d):
    kept = T.truncated(frames_of(s, d), "last", 5, 40).withColumn("gripper", T.repaired_gripper(F.col("gripper")))
    return r6(stats.large_stats(written_once(kept.select("repo_no", "gripper"), "repaired"), ["repo_no"], ["gripper"]), "mean", "std", "q50").select("repo_no", "min", "max", "mean", "std", "count", "q50")


@query("agg_03_merged_stats", """WITH p AS (SELECT repo_no, min(pan) AS lo, max(pan) AS hi, avg(pan) AS m, stddev_pop(pan) AS sd, count(*) AS n, quantile_cont(pan, 0.5) AS q50 FROM frames GROUP BY 1)
 SELECT 'pan' AS dim, min(lo) AS min, max(hi) AS max, round(sum(m * n) / sum(n), 6) AS mean, round(sqrt(greatest(sum((sd * sd + m * m) * n) / sum(n) - (sum(m * n) / sum(n)) ** 2, 0)), 6) AS std, CAST(sum(n) AS BIGINT) AS count, round(sum(q50 * n) / sum(n), 6) AS q50_wavg FROM p""")
def agg_03(s, d):
    parts = stats.large_stats(written_once(frames_of(s, d).select("repo_no", "pan"), "frames"), ["repo_no"], ["pan"])
    return r6(stats.merged_stats(parts, ["dim"]), "mean", "std", "q50_wavg").select("dim", "min", "max", "mean", "std", "count", "q50_wavg")


@query("agg_06_scalar_summary", """SELECT repo_no, min(gripper) AS min, max(gripper) AS max, round(avg(gripper), 6) AS mean, round(stddev_pop(gripper), 6) AS std, round(quantile_cont(gripper, 0.5), 6) AS q50, round(quantile_cont(gripper, 0.9), 6) AS q90, round(quantile_cont(gripper, 0.95), 6) AS q95, round(quantile_cont(gripper, 0.99), 6) AS q99 FROM frames GROUP BY 1""")
def agg_06(s, d):
    return r6(stats.scalar_summary(frames_of(s, d), ["repo_no"], "gripper"), "mean", "std", "q50", "q90", "q95", "q99")


@query("agg_11_centroids", """WITH p AS (SELECT repo_no, episode_index, CASE WHEN abs(max(pan)) >= abs(min(pan)) THEN max(pan) ELSE min(pan) END AS peak FROM frames GROUP BY 1, 2)
 SELECT ['left', 'middle', 'right'][CAST(repo_no % 3 AS INT) + 1] AS position, round(quantile_cont(peak, 0.5), 6) AS centroid, count(*) AS episodes FROM p GROUP BY 1""")
def agg_11(s, d):
    return r6(audit.calibration(audit.peaks(frames_of(s, d))), "centroid")


@query("agg_11_boundaries", """WITH p AS (SELECT repo_no, episode_index, CASE WHEN abs(max(pan)) >= abs(min(pan)) THEN max(pan) ELSE min(pan) END AS peak FROM frames GROUP BY 1, 2),
 c AS (SELECT ['left', 'middle', 'right'][CAST(repo_no % 3 AS INT) + 1] AS position, quantile_cont(peak, 0.5) AS centroid FROM p GROUP BY 1),
 g AS (SELECT position AS lower, lead(position) OVER w AS upper, (centroid + lead(centroid) OVER w) / 2 AS midpoint, lead(centroid) OVER w - centroid AS gap FROM c WINDOW w AS (ORDER BY centroid, position))
 SELECT lower, upper, round(midpoint, 6) AS midpoint, round(gap, 6) AS gap, min(gap) OVER () >= 5 AS separable FROM g WHERE upper IS NOT NULL""")
def agg_11_boundaries(s, d):
    return r6(audit.boundaries(audit.calibration(audit.peaks(frames_of(s, d)))), "midpoint", "gap")


@query("agg_18_rollup", f"WITH {TRUNC.format(end='l + 1')} SELECT repo_no, min(kept) AS kept_min, round(avg(kept), 6) AS kept_mean, max(kept) AS kept_max, count(*) AS episodes FROM t GROUP BY GROUPING SETS ((repo_no), ())")
def agg_18(s, d):
    return T.truncation(frames_of(s, d), "last", 5, 40).rollup("repo_no").agg(F.min("kept").alias("kept_min"), F.round(F.avg("kept"), 6).alias("kept_mean"), F.max("kept").alias("kept_max"), F.count(F.lit(1)).alias("episodes"))


@query("dq_01_placement_share", """WITH p AS (SELECT repo_no, episode_index, ['left', 'middle', 'right'][CAST(repo_no % 3 AS INT) + 1] AS position, CASE WHEN abs(max(pan)) >= abs(min(pan)) THEN max(pan) ELSE min(pan) END AS peak FROM frames GROUP BY 1, 2),
 c AS (SELECT position AS near, quantile_cont(peak, 0.5) AS centroid, CASE position WHEN 'left' THEN 0 WHEN 'right' THEN 1 ELSE 2 END AS tie FROM p GROUP BY 1),
 j AS (SELECT repo_no, position, near, row_number() OVER (PARTITION BY repo_no, episode_index ORDER BY abs(peak - centroid), tie) AS r FROM p, c)
 SELECT repo_no, count(*) AS episodes, CAST(sum(CAST(near = position AS INT)) AS BIGINT) AS placed, round(avg(CAST(near = position AS INT)), 6) AS share, CASE WHEN avg(CAST(near = position AS INT)) >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM j WHERE r = 1 GROUP BY 1""")
def dq_01(s, d):
    return audit.placement_share(frames_of(s, d))


@query("jn_11_action_chunks", """WITH x AS (SELECT repo_no, episode_index, frame_index, list(pan) OVER (PARTITION BY repo_no, episode_index ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS a FROM frames)
 SELECT repo_no, episode_index, frame_index, len(a) AS n_valid, list_sum(a) + (10 - len(a)) * a[len(a)] AS chunk_sum FROM x""")
def jn_11(s, d):
    c = T.action_chunks(frames_of(s, d), "pan", 10)
    return c.select(*EP, "frame_index", F.col("n_valid").cast("long").alias("n_valid"), F.expr("aggregate(chunk, 0D, (a, x) -> a + x)").alias("chunk_sum"))


@query("jn_14_repo_pairs", """SELECT a.repo_no AS repo_a, b.repo_no AS repo_b, count(*) AS rows_compared, round(max(abs(a.m - b.m)), 6) AS max_diff, round(avg(abs(a.m - b.m)), 6) AS mean_diff
 FROM (SELECT repo_no, frame_index, avg(pan) AS m FROM frames GROUP BY 1, 2) a JOIN (SELECT repo_no, frame_index, avg(pan) AS m FROM frames GROUP BY 1, 2) b ON a.frame_index = b.frame_index AND a.repo_no % 3 = b.repo_no % 3 AND a.repo_no < b.repo_no GROUP BY 1, 2""")
def jn_14(s, d):
    m = frames_of(s, d).groupBy("repo_no", "frame_index").agg(F.avg("pan").alias("m")).withColumn("slot", F.col("repo_no") % 3)
    j = m.alias("a").join(m.alias("b"), (F.col("a.slot") == F.col("b.slot")) & (F.col("a.frame_index") == F.col("b.frame_index")) & (F.col("a.repo_no") < F.col("b.repo_no")))
    e = F.abs(F.col("a.m") - F.col("b.m"))
    return j.groupBy(F.col("a.repo_no").alias("repo_a"), F.col("b.repo_no").alias("repo_b")).agg(F.count(F.lit(1)).alias("rows_compared"), F.round(F.max(e), 6).alias("max_diff"), F.round(F.avg(e), 6).alias("mean_diff"))


@query("prj_01_repo_names", """SELECT DISTINCT repo_no, 'dataset_v2' AS corpus, ['person_a', 'person_b', 'person_c'][CAST(repo_no // 3 AS INT) + 1] AS identity, ['left', 'middle', 'right'][CAST(repo_no % 3 AS INT) + 1] AS position, CAST(repo_no % 3 AS INT) AS label FROM frames""")
def prj_01(s, d):
    f = repo_names(frames_of(s, d).select("repo_no").distinct())
    p = N.parsed_repo(F.col("repo_id"), ("person_a", "person_b", "person_c"))
    return f.select("repo_no", *[c.alias(k) for k, c in p.items()], N.slot_label(N.slot_of(F.col("repo_id"))).alias("label"))


@query("flt_04_frame_cap", "SELECT repo_no, count(*) AS frames, count(DISTINCT episode_index) AS episodes FROM frames WHERE frame_index < 40 GROUP BY 1")
def flt_04(s, d):
    return frames_of(s, d).where("frame_index < 40").groupBy("repo_no").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("episode_index").alias("episodes"))


@query("flt_05_filter_text", "SELECT repo_no, episode_index, count(*) AS frames FROM frames WHERE (repo_no, episode_index) IN ((0, 9), (0, 18), (2, 2)) GROUP BY 1, 2")
def flt_05(s, d):
    keep = mix.parsed_filter(s, "0:9,18;2:2,x;bad;:3").select(F.col("repo").cast("long").alias("repo_no"), F.col("episode").alias("episode_index"))
    return mix.kept_episodes(frames_of(s, d), keep=F.broadcast(keep)).groupBy(*EP).agg(F.count(F.lit(1)).alias("frames"))


HASH = "CAST(('0x' || substr(md5({t}), 7, 2) || substr(md5({t}), 5, 2) || substr(md5({t}), 3, 2) || substr(md5({t}), 1, 2)) AS BIGINT)"


@query("hsh_01_stable_flags", f"SELECT c_custkey, {HASH.format(t='c_name')} AS h, {HASH.format(t='c_name')} / 4294967295.0 < 0.3 AS flag FROM customer")
def hsh_01(s, d):
    return read(s, d, "customer").select("c_custkey", N.stable_hash(F.col("c_name")).alias("h"), N.chance(F.col("c_name"), 0.3).alias("flag"))


@query("smp_06_interior_frames", f"WITH {LEN} SELECT DISTINCT repo_no, episode_index, CAST(floor(n * i / 5) AS BIGINT) AS frame_index FROM length_, range(1, 5) r(i)")
def smp_06(s, d):
    lengths = frames_of(s, d).groupBy(*EP).agg(F.count(F.lit(1)).alias("length"))
    return mix.interior_frames(lengths, 4).select(*EP, F.col("frame_index").cast("long").alias("frame_index"))


@query("smp_07_seeded_pick", "SELECT n_nationkey, n_regionkey FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY md5('7:pick:' || n_nationkey), n_nationkey) AS r FROM nation) WHERE r <= 2")
def smp_07(s, d):
    return mix.seeded_pick(read(s, d, "nation").select("n_nationkey", "n_regionkey"), ["n_regionkey"], "n_nationkey", 7, "pick", 2)


@query("smp_12_episode_split", f"SELECT repo_no, count(*) FILTER (WHERE {HASH.format(t="'1:' || repo_no || ':' || episode_index")} / 4294967295.0 < 0.2) AS validation_frames, count(*) AS frames FROM frames GROUP BY 1")
def smp_12(s, d):
    return mix.episode_split(frames_of(s, d), 0.2, 1).groupBy("repo_no").agg(F.count_if(F.col("split") == "validation").alias("validation_frames"), F.count(F.lit(1)).alias("frames"))


@query("smp_09_replication", "SELECT repo_no, count(*) AS frames, CAST(sum(repo_no % 4) AS BIGINT) AS virtual_frames FROM frames WHERE repo_no % 4 >= 1 GROUP BY 1")
def smp_09(s, d):
    f = frames_of(s, d).withColumn("weight", (F.col("repo_no") % 4).cast("int"))
    return mix.replicated(f, "weight").groupBy("repo_no").agg(F.count_if(F.col("copy") == 0).alias("frames"), F.count(F.lit(1)).alias("virtual_frames"))


@query("mth_05_normalise", "SELECT p_partkey, round(CASE WHEN q.b > q.a THEN greatest(-1, least(1, 2 * (p_retailprice - q.a) / (q.b - q.a) - 1)) ELSE 0 END, 6) AS y FROM part, (SELECT quantile_cont(p_retailprice, 0.01) AS a, quantile_cont(p_retailprice, 0.99) AS b FROM part) q")
def mth_05(s, d):
    p = read(s, d, "part")
    q = stats.exact_quantiles(p, [], "p_retailprice", (0.01, 0.99)).withColumnsRenamed({"q0": "a", "q1": "b"})
    return p.crossJoin(F.broadcast(q)).select("p_partkey", F.round(N.normalised(F.col("p_retailprice"), F.col("a"), F.col("b")), 6).alias("y"))  # one row


@query("mth_08_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS l2 FROM embeddings")
def mth_08(s, d):
    return read(s, d, "embeddings").select("vec_id", F.round(F.sqrt(F.expr("aggregate(embedding, 0D, (a, x) -> a + double(x) * double(x))")), 5).alias("l2"))


@query("mth_08_l1_and_pairs", """SELECT a.vec_id, round(list_sum(list_transform(a.embedding, lambda x: abs(CAST(x AS DOUBLE)))) / len(a.embedding), 5) AS l1_mean,
 round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))), 5) AS l2_next FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def mth_08_pairs(s, d):
    e = read(s, d, "embeddings").select("vec_id", "embedding")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id", "left")
    return j.select("vec_id", F.round(F.expr("aggregate(embedding, 0D, (a, x) -> a + abs(double(x))) / size(embedding)"), 5).alias("l1_mean"), F.round(F.sqrt(F.expr("aggregate(zip_with(embedding, other, (x, y) -> double(x) - double(y)), 0D, (a, x) -> a + x * x)")), 5).alias("l2_next"))


@query("mth_09_ramps", "SELECT p_partkey, round(greatest(0, least(1, 1 - p_size / 40.0)), 6) AS down, round(greatest(0, least(1, p_retailprice / 1000.0)), 6) AS up FROM part")
def mth_09(s, d):
    return read(s, d, "part").select("p_partkey", F.round(N.ramp_down(F.col("p_size"), 40.0), 6).alias("down"), F.round(N.ramp_up(F.col("p_retailprice"), 1000.0), 6).alias("up"))


@query("mth_12_cosine_decay", "SELECT o_orderkey, round(1 + 9 * 0.5 * (1 + cos(greatest(0, least(1, o_orderkey / 10000.0)) * pi())), 6) AS sigma FROM orders")
def mth_12(s, d):
    return read(s, d, "orders").select("o_orderkey", F.round(N.cosine_decay(F.col("o_orderkey"), 10000.0, 10.0, 1.0), 6).alias("sigma"))


@query("str_01_plain_slugs", "SELECT p_partkey, lower(trim(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS slug FROM part")
def str_01_plain(s, d):
    return read(s, d, "part").select("p_partkey", N.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("top_01_ranked_photos", "SELECT p_brand AS slug, p_partkey AS path, p_retailprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 10")
def top_01(s, d):
    return read(s, d, "part").withColumn("r", F.expr("row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)")).where("r <= 10").selectExpr("p_brand AS slug", "p_partkey AS path", "p_retailprice AS score")


@query("st_04_action_guard", """WITH RECURSIVE t AS (SELECT user_id AS rollout, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS step, least(value, 60.0) AS v FROM events),
 g AS (SELECT rollout, step, v + 2 AS sent FROM t WHERE step = 0 UNION ALL SELECT t.rollout, t.step, g.sent + least(5, greatest(-5, 0.5 * (t.v + 2) + 0.5 * g.sent - g.sent)) FROM g JOIN t ON t.rollout = g.rollout AND t.step = g.step + 1)
 SELECT rollout, step, sent FROM g""")
def st_04(s, d):
    ticks = frames_of(s, d).selectExpr("episode_index AS rollout", "frame_index AS step", "gripper AS value")
    return guards.action_guard(ticks)
