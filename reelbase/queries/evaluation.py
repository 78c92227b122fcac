"""Queries of scoring, evaluation roll-ups, rankings and row augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbase.functions import names as N
from reelbase.functions import text as X
from reelbase.operators import augment as A
from reelbase.operators import timeseries as T
from reelbase.operators.ranks import met, selected_quantiles
from reelbase.plans import scoring as S
from reelbase.queries.base import LEN, query, r6
from reelbase.sources.adapters import frames_of, read
from reelbase.sources.storage import written_once

HASH = "CAST(('0x' || substr(md5({t}), 7, 2) || substr(md5({t}), 5, 2) || substr(md5({t}), 3, 2) || substr(md5({t}), 1, 2)) AS BIGINT)"
PRED = f"""p0 AS (SELECT f.*, repo_no % 3 AS position, repo_no // 3 AS identity, c.checkpoint, q.prompt, {HASH.format(t="c.checkpoint || ':' || q.prompt || ':' || event_id")} AS h
 FROM frames f, (SELECT unnest([0, 1]) AS checkpoint) c, (SELECT unnest([0, 1, 2]) AS prompt) q),
 p AS (SELECT *, pan + h % 41 - 20 AS p_pan, lift + h % 23 - 11 AS p_lift, sqrt((h % 41 - 20) ** 2 + (h % 23 - 11) ** 2) AS dist FROM p0)"""
NEAR = f"""{PRED}, near AS (SELECT checkpoint, event_id, identity, position, repo_no, nearest, nearest = identity AS correct FROM
 (SELECT *, prompt AS nearest, row_number() OVER (PARTITION BY checkpoint, event_id ORDER BY dist, prompt) AS r FROM p) WHERE r = 1)"""
PAIRS = f"{PRED}, pairs AS (SELECT a.checkpoint, a.event_id, a.identity, a.prompt AS prompt_a, b.prompt AS prompt_b, sqrt((a.p_pan - b.p_pan) ** 2 + (a.p_lift - b.p_lift) ** 2) AS l2 FROM p a JOIN p b ON a.checkpoint = b.checkpoint AND a.event_id = b.event_id AND a.prompt < b.prompt)"


def preds(s, d):
    return S.predictions_view(frames_of(s, d))


@query("ev_01_errors", f"WITH {PRED}, e AS (SELECT checkpoint, avg(abs(p_pan - pan)) AS a, avg(abs(p_lift - lift)) AS b, avg(dist) AS l FROM p GROUP BY 1) SELECT checkpoint, round(a, 6) AS pan_mae, round(b, 6) AS lift_mae, round(l, 6) AS l2, round((a + b) / 2, 6) AS mae, CASE WHEN a >= b THEN 'pan' ELSE 'lift' END AS worst FROM e")
def ev_01(s, d):
    return r6(S.joint_errors(preds(s, d)), "pan_mae", "lift_mae", "l2", "mae")


@query("ev_02_nearest", f"WITH {NEAR} SELECT checkpoint, identity, nearest, count(*) AS samples FROM near GROUP BY 1, 2, 3")
def ev_02(s, d):
    return S.nearest_prompt(preds(s, d)).groupBy("checkpoint", "identity", "nearest").agg(F.count(F.lit(1)).alias("samples"))


@query("ev_03_pairs", f"WITH {PAIRS} SELECT checkpoint, prompt_a, prompt_b, round(avg(l2), 6) AS l2, round(avg(l2) FILTER (WHERE identity IN (prompt_a, prompt_b)), 6) AS true_against_other FROM pairs GROUP BY 1, 2, 3")
def ev_03(s, d):
    own = (F.col("identity") == F.col("prompt_a")) | (F.col("identity") == F.col("prompt_b"))
    return r6(S.prompt_pairs(preds(s, d)).groupBy("checkpoint", "prompt_a", "prompt_b").agg(F.avg("l2").alias("l2"), F.avg(F.when(own, F.col("l2"))).alias("true_against_other")), "l2", "true_against_other")


@query("ev_04_breakdown", f"WITH {PRED}, {LEN} SELECT checkpoint, identity, position, round(avg(dist), 6) AS l2, round(avg(dist) FILTER (WHERE frame_index >= floor(0.75 * (n - 1))), 6) AS final_l2 FROM p JOIN length_ USING (repo_no, episode_index) GROUP BY 1, 2, 3")
def ev_04(s, d):
    p = S.predictions_view(T.with_length(frames_of(s, d)))
    return r6(p.groupBy("checkpoint", "identity", "position").agg(F.avg("dist").alias("l2"), F.expr("avg(dist) FILTER (WHERE frame_index >= floor(0.75 * (n - 1)))").alias("final_l2")), "l2", "final_l2")


@query("ev_05_slot_accuracy", f"WITH {PRED} SELECT checkpoint, repo_no, round(avg(CASE WHEN repo_no = 8 OR h % 5 = 0 THEN NULL WHEN h % 3 = position THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY 1, 2")
def ev_05(s, d):
    hit = F.when((F.col("repo_no") == 8) | (F.col("h") % 5 == 0), None).when(F.col("h") % 3 == F.col("position"), 1.0).otherwise(0.0)
    return preds(s, d).groupBy("checkpoint", "repo_no").agg(F.round(F.avg(hit), 6).alias("accuracy"))


PARTS = f"""{NEAR}, {LEN}, a AS (SELECT checkpoint, avg(CAST(correct AS INT)) AS nearest FROM near GROUP BY 1),
 f AS (SELECT checkpoint, avg(CAST(correct AS INT)) AS final FROM near JOIN (SELECT event_id FROM frames JOIN length_ USING (repo_no, episode_index) WHERE frame_index >= floor(0.75 * (n - 1))) USING (event_id) GROUP BY 1),
 m AS (SELECT checkpoint, avg(dist) AS mae, stddev_pop(p_pan) AS separation FROM p GROUP BY 1), j AS (SELECT checkpoint, nearest, final, mae, separation FROM a JOIN f USING (checkpoint) JOIN m USING (checkpoint))"""


def parts(s, d):
    p = S.predictions_view(T.with_length(frames_of(s, d))).withColumn("is_final", F.expr("frame_index >= floor(0.75 * (n - 1))"))
    near = S.nearest_prompt(p)
    late = p.where("is_final").select(*S.SAMPLE).distinct().withColumn("late", F.lit(True))
    acc = near.join(late, S.SAMPLE, "left").withColumn("hit", F.col("correct").cast("int"))
    acc = acc.groupBy("checkpoint").agg(F.avg("hit").alias("nearest"), F.avg(F.when(F.col("late"), F.col("hit"))).alias("final"))
    return acc.join(p.groupBy("checkpoint").agg(F.avg("dist").alias("mae"), F.stddev_pop("p_pan").alias("separation")), "checkpoint")


@query("ev_06_offline_score", f"WITH {PARTS} SELECT checkpoint, round(0.30 * nearest + 0.25 * final + 0.15 * greatest(0, least(1, 1 - mae / 30.0)) + 0.15 * greatest(0, least(1, separation / 20.0)) + 0.10 * 0.5 + 0.05 * 0.5, 6) AS score, concat_ws(',', CASE WHEN nearest < 0.5 THEN 'nearest accuracy' END, CASE WHEN mae > 20 THEN 'error' END) AS failed FROM j")
def ev_06(s, d):
    p = parts(s, d)
    m = {k: F.col(k) for k in ("nearest", "final", "mae", "separation")} | {"bend": F.lit(50.0), "robust": F.lit(5.0)}
    return p.select("checkpoint", F.round(S.offline_score(m), 6).alias("score"), S.failures({"nearest accuracy": F.col("nearest") >= 0.5, "error": F.col("mae") <= 20}).alias("failed"))


@query("ev_07_threshold_failures", f"WITH {PRED}, e AS (SELECT checkpoint, repo_no, unnest(['pan', 'lift']) AS joint, unnest([avg(abs(p_pan - pan)), avg(abs(p_lift - lift))]) AS mae FROM p GROUP BY 1, 2) SELECT checkpoint, repo_no, joint, round(mae, 6) AS mae FROM e WHERE mae > 10.2")
def ev_07(s, d):
    e = preds(s, d).groupBy("checkpoint", "repo_no").agg(F.avg(F.abs(F.col("p_pan") - F.col("pan"))).alias("pan"), F.avg(F.abs(F.col("p_lift") - F.col("lift"))).alias("lift"))
    return r6(e.unpivot(["checkpoint", "repo_no"], ["pan", "lift"], "joint", "mae").where("mae > 10.2"), "mae")


@query("ev_08_variant_gate", f"WITH {PAIRS}, v AS (SELECT checkpoint, event_id % 4 AS variant, prompt_a, prompt_b, avg(l2) AS l2 FROM pairs GROUP BY 1, 2, 3, 4) SELECT checkpoint, variant, round(avg(l2), 6) AS mean_pair, round(min(l2), 6) AS min_pair, min(l2) >= 18 AS gate FROM v GROUP BY 1, 2")
def ev_08(s, d):
    v = S.prompt_pairs(preds(s, d)).groupBy("checkpoint", (F.col("event_id") % 4).alias("variant"), "prompt_a", "prompt_b").agg(F.avg("l2").alias("l2"))
    return v.groupBy("checkpoint", "variant").agg(F.round(F.avg("l2"), 6).alias("mean_pair"), F.round(F.min("l2"), 6).alias("min_pair"), (F.min("l2") >= 18).alias("gate"))


@query("ev_09_swap_verdict", f"WITH {PAIRS}, a AS (SELECT checkpoint, avg(l2) AS l FROM pairs GROUP BY 1) SELECT checkpoint, CASE WHEN l >= 20 THEN 'SENSITIVE' WHEN l >= 5 THEN 'WEAK' ELSE 'BLIND' END AS verdict FROM a")
def ev_09(s, d):
    a = S.prompt_pairs(preds(s, d)).groupBy("checkpoint").agg(F.avg("l2").alias("l"))
    return a.select("checkpoint", F.when(F.col("l") >= 20, "SENSITIVE").when(F.col("l") >= 5, "WEAK").otherwise("BLIND").alias("verdict"))


@query("ev_10_combined_gate", f"WITH {PARTS}, g AS (SELECT checkpoint, 'nearest' AS metric, 100 * nearest AS x FROM j UNION ALL SELECT checkpoint, 'separation', separation FROM j) SELECT checkpoint, ['FAIL', 'WEAK', 'PASS'][min(CASE WHEN x >= 34 THEN 2 WHEN x >= 5 THEN 1 ELSE 0 END) + 1] AS overall FROM g GROUP BY 1")
def ev_10(s, d):
    tiers = F.array(F.lit("FAIL"), F.lit("WEAK"), F.lit("PASS"))
    p = parts(s, d).select("checkpoint", (100 * F.col("nearest")).alias("nearest"), "separation").unpivot("checkpoint", ["nearest", "separation"], "metric", "x")
    worst = p.groupBy("checkpoint").agg(F.min(F.array_position(tiers, N.gate(F.col("x"), 34.0))).cast("int").alias("code"))
    return worst.select("checkpoint", F.element_at(tiers, F.col("code")).alias("overall"))


@query("ev_11_robustness", f"WITH {PAIRS}, v AS (SELECT checkpoint, event_id % 4 AS variant, prompt_a, prompt_b, avg(l2) AS l2 FROM pairs GROUP BY 1, 2, 3, 4), w AS (SELECT checkpoint, variant, min(l2) AS lo FROM v GROUP BY 1, 2) SELECT checkpoint, round(avg(lo), 6) AS mean_of_min, round(min(lo), 6) AS least FROM w GROUP BY 1")
def ev_11(s, d):
    v = S.prompt_pairs(preds(s, d)).groupBy("checkpoint", (F.col("event_id") % 4).alias("variant"), "prompt_a", "prompt_b").agg(F.avg("l2").alias("l2"))
    w = v.groupBy("checkpoint", "variant").agg(F.min("l2").alias("lo"))
    return r6(w.groupBy("checkpoint").agg(F.avg("lo").alias("mean_of_min"), F.min("lo").alias("least")), "mean_of_min", "least")


LOSS = f"""{PRED}, b AS (SELECT checkpoint, repo_no, event_id // 64 AS batch, avg(dist) AS loss, count(*) AS n FROM p GROUP BY 1, 2, 3), g AS (SELECT checkpoint, repo_no, sum(loss * n) / sum(n) AS loss FROM b GROUP BY GROUPING SETS ((checkpoint, repo_no), (checkpoint)))"""


def losses(s, d):
    b = preds(s, d).groupBy("checkpoint", "repo_no", F.expr("event_id div 64").alias("batch")).agg(F.avg("dist").alias("loss"), F.count(F.lit(1)).alias("n"))
    return b.groupingSets([["checkpoint", "repo_no"], ["checkpoint"]], "checkpoint", "repo_no").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


@query("agg_21_weighted_loss", f"WITH {LOSS} SELECT checkpoint, repo_no, round(loss, 6) AS loss FROM g")
def agg_21(s, d):
    return r6(losses(s, d), "loss")


@query("ev_12_loss_ranking", f"WITH {LOSS} SELECT checkpoint, round(loss, 6) AS loss, row_number() OVER (ORDER BY loss, checkpoint) AS place FROM g WHERE repo_no IS NULL")
def ev_12(s, d):
    # one row per checkpoint
    return losses(s, d).where("repo_no IS NULL").selectExpr("checkpoint", "round(loss, 6) AS loss", "row_number() OVER (ORDER BY loss, checkpoint) AS place")


TRIALS = f"{NEAR}, t AS (SELECT identity, position, checkpoint, correct, event_id % 10 AS score FROM near)"


@query("agg_22_success_matrix", f"WITH {TRIALS} SELECT identity, position, count(*) FILTER (WHERE correct) AS hits, count(*) AS trials, quantile_cont(score, 0.5) AS median_score FROM t GROUP BY CUBE (identity, position)")
def agg_22(s, d):
    t = S.nearest_prompt(preds(s, d)).withColumn("score", F.col("event_id") % 10)
    # each trial counts in the four sets of the cube; the groups may be large, so their medians are selected over ranges
    sets = F.array(*[F.struct(F.when(F.lit(a), F.col("identity")).alias("identity"), F.when(F.lit(b), F.col("position")).alias("position")) for a in (True, False) for b in (True, False)])
    long = t.select("correct", "score", F.explode(sets).alias("g")).select("g.identity", "g.position", "correct", "score")
    long = written_once(long.groupBy("identity", "position", "score").agg(F.count_if("correct").alias("hits"), F.count(F.lit(1)).alias("trials")), "cube")
    n = long.groupBy("identity", "position").agg(F.sum("hits").alias("hits"), F.sum("trials").alias("trials"))
    median = selected_quantiles(long, ["identity", "position"], "score", (0.5,), weight="trials")
    return met(n, median, ["identity", "position"]).select("identity", "position", "hits", "trials", F.col("q0").alias("median_score"))


@query("ev_13_scoreboard", f"WITH {TRIALS} SELECT checkpoint, identity, round(avg(CAST(correct AS INT)), 6) AS rate FROM t GROUP BY 1, 2 HAVING count(*) FILTER (WHERE correct) >= 2 AND max(score) < 10")
def ev_13(s, d):
    t = S.nearest_prompt(preds(s, d)).withColumn("score", F.col("event_id") % 10)
    g = t.groupBy("checkpoint", "identity").agg(F.round(F.avg(F.col("correct").cast("int")), 6).alias("rate"), F.count_if("correct").alias("hits"), F.max("score").alias("top"))
    return g.where("hits >= 2 AND top < 10").select("checkpoint", "identity", "rate")


@query("ev_14_slot_spread", f"WITH {PRED}, c AS (SELECT checkpoint, event_id, max(p_pan) - min(p_pan) AS spread, count(*) FILTER (WHERE CASE WHEN p_pan > 12 THEN 0 WHEN p_pan < -12 THEN 2 ELSE 1 END = position) AS hits FROM p GROUP BY 1, 2) SELECT checkpoint, round(avg(spread), 6) AS spread, count(*) FILTER (WHERE hits = 3) AS full_hits, avg(spread) >= 20 AS healthy FROM c GROUP BY 1")
def ev_14(s, d):
    slot = F.array_position(F.array(F.lit("left"), F.lit("middle"), F.lit("right")), N.three_way(F.col("p_pan"))) - 1
    c = preds(s, d).groupBy("checkpoint", "event_id").agg((F.max("p_pan") - F.min("p_pan")).alias("spread"), F.count_if(slot == F.col("position")).alias("hits"))
    return c.groupBy("checkpoint").agg(F.round(F.avg("spread"), 6).alias("spread"), F.count_if(F.col("hits") == 3).alias("full_hits"), (F.avg("spread") >= 20).alias("healthy"))


@query("ev_15_head_accuracy", f"WITH {PRED}, m AS (SELECT repo_no, position, avg(exp(pan / 30) / (exp(pan / 30) + exp(lift / 30) + exp(elbow / 30))) AS a, avg(exp(lift / 30) / (exp(pan / 30) + exp(lift / 30) + exp(elbow / 30))) AS b, avg(exp(elbow / 30) / (exp(pan / 30) + exp(lift / 30) + exp(elbow / 30))) AS c FROM frames f2 JOIN (SELECT DISTINCT event_id, position FROM p) USING (event_id) GROUP BY 1, 2) SELECT repo_no, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS said, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END = position AS correct FROM m")
def ev_15(s, d):
    probability = X.softmax(F.array(*[F.col(c) / 30 for c in ("pan", "lift", "elbow")]))
    f = frames_of(s, d).withColumn("x", probability)
    m = f.groupBy("repo_no").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(3)]).alias("mean"))
    said = X.argmax(F.col("mean")).cast("int")
    return m.select("repo_no", said.alias("said"), (said == F.col("repo_no") % 3).alias("correct"))


@query("ev_16_prompt_spread", f"WITH {PRED}, c AS (SELECT checkpoint, event_id, max(p_pan) - min(p_pan) AS x FROM p GROUP BY 1, 2) SELECT checkpoint, CASE WHEN x > 10 THEN 'high' WHEN x > 2 THEN 'some' ELSE 'none' END AS tier, count(*) AS frames, round(avg(x), 6) AS mean, max(x) AS max FROM c GROUP BY 1, 2")
def ev_16(s, d):
    c = preds(s, d).groupBy("checkpoint", "event_id").agg((F.max("p_pan") - F.min("p_pan")).alias("x"))
    tier = F.when(F.col("x") > 10, "high").when(F.col("x") > 2, "some").otherwise("none")
    return c.groupBy("checkpoint", tier.alias("tier")).agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("x"), 6).alias("mean"), F.max("x").alias("max"))


@query("agg_19_rollup", f"WITH {NEAR}, s AS (SELECT unnest([0, 1, 2, 3]) AS position), r AS (SELECT position, repo_no, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM near GROUP BY GROUPING SETS ((), (position), (repo_no))) SELECT position, repo_no, n, accuracy FROM r WHERE position IS NULL UNION ALL SELECT s.position, NULL, coalesce(n, 0), accuracy FROM s LEFT JOIN r ON s.position = r.position")
def agg_19(s, d):
    near = S.nearest_prompt(preds(s, d))
    r = near.groupingSets([[], ["position"], ["repo_no"]], "position", "repo_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))
    slots = s.createDataFrame([(i,) for i in range(4)], "position long")  # every slot has a row, the empty one too
    per_slot = slots.join(r.where("position IS NOT NULL"), "position", "left").select("position", F.lit(None).cast("long").alias("repo_no"), F.coalesce("n", F.lit(0)).alias("n"), "accuracy")
    return r.where("position IS NULL").select("position", "repo_no", "n", "accuracy").unionByName(per_slot)


@query("top_04_checkpoint_ranking", f"WITH {PARTS} SELECT checkpoint, row_number() OVER (ORDER BY nearest DESC, coalesce(final, 0) DESC, coalesce(separation, 0) DESC, mae) AS place FROM j")
def top_04(s, d):
    # one row per checkpoint
    return parts(s, d).selectExpr("checkpoint", "row_number() OVER (ORDER BY nearest DESC, coalesce(final, 0) DESC, coalesce(separation, 0) DESC, mae) AS place")


@query("top_05_shortlist", "WITH r AS (SELECT p_type, p_partkey, p_retailprice AS score, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r, max(p_retailprice) OVER () AS best FROM part) SELECT p_partkey, p_type, score FROM r ORDER BY r > 1, CASE WHEN r = 1 OR score >= 0.95 * best THEN 0 ELSE 1 END, score DESC, p_partkey LIMIT 5")
def top_05(s, d):
    p = read(s, d, "part").select("p_partkey", "p_type", F.col("p_retailprice").alias("score"))
    best = F.broadcast(p.agg(F.max("score").alias("best")))  # one row
    r = p.withColumn("r", F.expr("row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_partkey)")).crossJoin(best)
    near = r.where("r = 1 OR score >= 0.95 * best")
    return near.orderBy(F.col("r") > 1, F.desc("score"), "p_partkey").limit(5).select("p_partkey", "p_type", "score")  # a shortlist of five


@query("top_06_worst_joint", f"WITH {PRED}, e AS (SELECT checkpoint, repo_no, avg(abs(p_pan - pan)) AS a, avg(abs(p_lift - lift)) AS b FROM p GROUP BY 1, 2) SELECT checkpoint, repo_no, CASE WHEN a >= b THEN 'pan' ELSE 'lift' END AS worst FROM e")
def top_06(s, d):
    e = preds(s, d).groupBy("checkpoint", "repo_no").agg(F.avg(F.abs(F.col("p_pan") - F.col("pan"))).alias("a"), F.avg(F.abs(F.col("p_lift") - F.col("lift"))).alias("b"))
    return e.select("checkpoint", "repo_no", F.when(F.col("a") >= F.col("b"), "pan").otherwise("lift").alias("worst"))


U = lambda tag: f"({HASH.format(t=f"'{tag}:' || event_id")} + 0.5) / 4294967296.0"


@query("aug_01_rewritten_tasks", f"WITH x AS (SELECT event_id, repo_no // 3 AS who, {U('p')} AS u, {U('v')} AS v FROM frames) SELECT event_id, CASE WHEN who > 1 THEN 'unknown' WHEN u < 0.5 THEN CASE WHEN v < 0.7 THEN 'put it on ' ELSE 'place it on ' END || who ELSE 'variant ' || CAST(floor(v * 19) AS INT) || ' ' || who END AS task FROM x")
def aug_01(s, d):
    who = F.expr("repo_no div 3")
    name = F.when(who <= 1, who.cast("string"))
    task = A.rewritten_task(F.lit("unknown"), name, [("put it on ", 0.7), ("place it on ", 0.3)], [f"variant {i} " for i in range(19)], 0.5, F.col("event_id"))
    return frames_of(s, d).select("event_id", task.alias("task"))


@query("aug_02_slot_wording", f"WITH x AS (SELECT event_id, repo_no % 3 AS slot, {U('s')} AS u FROM frames) SELECT event_id, CASE WHEN u < 0.3 THEN 'on the ' || ['left', 'middle', 'right'][CAST(slot AS INT) + 1] ELSE 'plain' END AS task FROM x")
def aug_02(s, d):
    slot = F.element_at(F.array(*map(F.lit, N.SLOTS)), (F.col("repo_no") % 3).cast("int") + 1)
    return frames_of(s, d).select("event_id", F.when(A.uniform("s", F.col("event_id")) < 0.3, F.concat(F.lit("on the "), slot)).otherwise("plain").alias("task"))


@query("aug_03_modes", f"WITH x AS (SELECT event_id, {U('m')} AS u FROM frames) SELECT event_id, 'raw' AS raw, 'canonical' AS canonical, CASE WHEN u < 0.5 THEN 'canonical' ELSE 'raw' END AS mixed FROM x")
def aug_03(s, d):
    modes = {m: A.by_mode(m, F.lit("raw"), F.lit("canonical"), F.col("event_id")).alias(m) for m in ("raw", "canonical", "mixed")}
    return frames_of(s, d).select("event_id", *modes.values())


NOISE = f"sqrt(-2 * ln({U('n0')})) * cos(2 * pi() * {U('n1')})"


@query("aug_04_state_noise", f"SELECT event_id, round(pan + {NOISE} * 5 * 2, 5) AS pan, round(gripper + {NOISE} * 5 * 3 * 0.1, 5) AS gripper FROM frames")
def aug_04(s, d):
    z = A.normal("n", F.col("event_id"))
    return frames_of(s, d).select("event_id", F.round(F.col("pan") + z * 5.0 * 2.0, 5).alias("pan"), F.round(F.col("gripper") + z * 5.0 * 3.0 * 0.1, 5).alias("gripper"))


@query("aug_05_state_replacement", f"WITH x AS (SELECT *, {U('r')} AS u, {U('w')} AS w, {NOISE} AS z FROM frames) SELECT event_id, round(CASE WHEN u >= 0.4 THEN pan WHEN w < 0.7 THEN 10 + z * 2 ELSE 0 END, 5) AS pan FROM x")
def aug_05(s, d):
    k = F.col("event_id")
    return frames_of(s, d).select("event_id", F.round(A.replaced(F.col("pan"), 0.4, 10.0, 2.0, 0.7, k), 5).alias("pan"))


@query("aug_06_post_grasp", f"WITH x AS (SELECT *, {U('g')} AS u, {NOISE} AS z FROM frames) SELECT event_id, round(CASE WHEN u < CASE WHEN gripper < 20 THEN 0.8 ELSE 0.2 END THEN pan + z * CASE WHEN gripper < 20 THEN 3 ELSE 1 END ELSE pan END, 5) AS pan FROM x")
def aug_06(s, d):
    k, closed = F.col("event_id"), F.col("gripper") < 20
    noisy = F.col("pan") + A.normal("n", k) * F.when(closed, 3).otherwise(1)
    return frames_of(s, d).select("event_id", F.round(F.when(A.uniform("g", k) < F.when(closed, 0.8).otherwise(0.2), noisy).otherwise(F.col("pan")), 5).alias("pan"))


@query("aug_07_camera_drop", f"SELECT event_id, {HASH.format(t="'cam:' || episode_index")} / 4294967295.0 < 0.1 AS by_episode, {U('c')} < CASE WHEN frame_index > 20 THEN 0.3 ELSE 0.1 END AS by_frame FROM frames")
def aug_07(s, d):
    by_episode = N.chance(F.concat(F.lit("cam:"), F.col("episode_index").cast("string")), 0.1)
    p = F.when(F.col("frame_index") > 20, 0.3).otherwise(0.1)
    return frames_of(s, d).select("event_id", by_episode.alias("by_episode"), (A.uniform("c", F.col("event_id")) < p).alias("by_frame"))


PLAN = " UNION ALL ".join(f"SELECT event_id, '{t}' AS transform, -ln({U('t' + t)}) / {w} AS k FROM frames WHERE repo_no <> 5" for t, w in (("blur", 1.0), ("crop", 2.0), ("hue", 1.0), ("noise", 0.5)))


@query("aug_08_plan", f"WITH k AS ({PLAN}), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k, transform) AS place FROM k) SELECT event_id, string_agg(transform, '>' ORDER BY place) AS plan FROM r WHERE place <= 2 GROUP BY 1")
def aug_08(s, d):
    f = frames_of(s, d).where("repo_no <> 5")
    return f.select("event_id", F.array_join(A.drawn({"blur": 1.0, "crop": 2.0, "hue": 1.0, "noise": 0.5}, 2, F.col("event_id")), ">").alias("plan"))
