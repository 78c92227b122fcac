"""The label audit: where an episode's arm goes, against where its dataset's name says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbase.operators.stats import exact_quantiles
from reelbase.operators.timeseries import ordered, signed_peak, with_length
from reelbase.sources.storage import written_once

POSITIONS = ("left", "middle", "right")


def position_of(repo: str = "repo_no"):
    return F.element_at(F.array(*map(F.lit, POSITIONS)), (F.col(repo) % 3).cast("int") + 1)


def peaks(frames: DataFrame) -> DataFrame:
    return signed_peak(frames, "pan").withColumn("position", position_of())


def calibration(peaks_df: DataFrame) -> DataFrame:
    """The median signed peak of each position."""
    median = exact_quantiles(peaks_df, ["position"], "peak", (0.5,)).withColumnRenamed("q0", "centroid")
    return median.join(peaks_df.groupBy("position").agg(F.count(F.lit(1)).alias("episodes")), "position")


def boundaries(centroids: DataFrame, least_gap: float = 5.0) -> DataFrame:
    """Between centroids next to each other: lower and upper position, midpoint, gap, and whether the smallest gap separates them all."""
    # one row per position
    step = centroids.withColumns({c: F.expr(f"lead({v}) OVER (ORDER BY centroid, position)") for c, v in (("upper", "position"), ("_next", "centroid"))})
    gaps = step.where("upper IS NOT NULL").select(F.col("position").alias("lower"), "upper", ((F.col("centroid") + F.col("_next")) / 2).alias("midpoint"), (F.col("_next") - F.col("centroid")).alias("gap"))
    return gaps.withColumn("separable", F.expr(f"min(gap) OVER () >= {least_gap}"))


def placement_share(frames: DataFrame, pass_at: float = 0.8) -> DataFrame:
    """Per dataset: episodes, those whose peak is nearest the centroid of their own position (ties: left, right, middle), share and verdict."""
    p = written_once(peaks(frames), "peaks")  # a row per episode
    c = calibration(p).select(F.col("position").alias("near"), "centroid")
    tie = F.when(F.col("near") == "left", 0).when(F.col("near") == "right", 1).otherwise(2)
    judged = p.crossJoin(F.broadcast(c)).groupBy("repo_no", "episode_index", "position").agg(F.min_by("near", F.struct(F.abs(F.col("peak") - F.col("centroid")), tie)).alias("nearest"))  # three centroids
    ok = (F.col("nearest") == F.col("position")).cast("int")
    return judged.groupBy("repo_no").agg(F.count(F.lit(1)).alias("episodes"), F.sum(ok).alias("placed"), F.round(F.avg(ok), 6).alias("share")).withColumn("verdict", F.when(F.col("share") >= pass_at, "PASS").otherwise("FAIL"))


def label_audit(frames: DataFrame, k: int) -> DataFrame:
    """Nine metrics per dataset, each the share of its episodes that pass, and a verdict: m1 the signed peak lies on the slot's side, m2 no wrong-side excursion
    over half the way, m3 the pose does not stay at the limit, m4 the wrist moves, m5 the end is calm, m6 the gripper is open at the end, m7 the length is
    plausible, m8 no missing values, m9 values in range. FAIL for m1, m8, m9, WARN for the others."""
    first, last = F.col("frame_index") < k, F.col("n") - F.col("frame_index") <= k
    mean = lambda c, w: F.avg(F.when(w, F.col(c)))
    e = with_length(frames).groupBy("repo_no", "episode_index", "n").agg(
        F.max("pan").alias("hi"),
        F.min("pan").alias("lo"),
        mean("pan", first).alias("s"),
        mean("pan", last).alias("t"),
        mean("wrist_flex", first).alias("ws"),
        mean("wrist_flex", last).alias("wt"),
        F.stddev_pop(F.when(last, F.col("pan"))).alias("sd"),
        F.max(F.when(last, F.col("gripper"))).alias("g"),
        F.bool_or(F.col("pan").isNull() | F.isnan("pan")).alias("bad"),
    )
    e = e.withColumn("slot", F.col("repo_no") % 3).withColumn("peak", F.expr("if(abs(hi) >= abs(lo), hi, lo)"))
    tests = {
        "m1": "CASE slot WHEN 0 THEN peak > 12 WHEN 2 THEN peak < -12 ELSE abs(peak) <= 12 END",
        "m2": "CASE slot WHEN 0 THEN greatest(0, -lo) WHEN 2 THEN greatest(0, hi) ELSE 0 END / 60.0 <= 0.5",
        "m3": "greatest(s, t) < 90",
        "m4": "abs(wt - ws) >= 5",
        "m5": "sd < 60",
        "m6": "g >= 20",
        "m7": "n BETWEEN 30 AND 900",
        "m8": "NOT bad",
        "m9": "hi <= 180 AND lo >= -180",
    }
    m = e.groupBy("repo_no").agg(*[F.expr(f"avg(cast({t} AS int))").alias(name) for name, t in tests.items()])
    verdict = F.expr("CASE WHEN m8 < 1 OR m9 < 1 OR m1 < 0.8 THEN 'FAIL' WHEN least(m2, m3, m4, m5, m6, m7) < 0.8 THEN 'WARN' ELSE 'PASS' END")
    return m.withColumn("verdict", verdict)


def gripper_audit(frames: DataFrame, open_at: float = 45.0, closed: float = 20.0, most_lag: float = 50.0, most_jerk: float = 80_000.0, fps: int = 30) -> DataFrame:
    """Per episode the flags of its gripper, joined by commas: never open, closed at end (median of the last quarter), lag (p95 of the step) and jerk (p99)."""
    w = ordered()
    g, one, two = F.col("gripper"), F.lag("gripper").over(w), F.lag("gripper", 2).over(w)
    x = with_length(frames).withColumns({"_lag": F.abs(g - F.coalesce(one, g)), "_jerk": F.abs(g - 2 * one + two) * fps * fps})
    late = F.when(F.col("frame_index") >= F.floor(F.col("n") * 0.75), g)
    e = x.groupBy("repo_no", "episode_index").agg(
        F.max(g).alias("top"), F.percentile(late, F.lit(0.5)).alias("late"), F.percentile("_lag", F.lit(0.95)).alias("lag"), F.coalesce(F.percentile("_jerk", F.lit(0.99)), F.lit(0.0)).alias("jerk")
    )
    flags = {"never open": F.col("top") < open_at, "closed at end": F.col("late") < closed, "lag": F.col("lag") > most_lag, "jerk": F.col("jerk") > most_jerk}
    return e.select("repo_no", "episode_index", F.array_join(F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in flags.items()])), ",").alias("flags"))
