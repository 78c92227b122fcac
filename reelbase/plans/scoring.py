"""Scoring of predictions: one row per checkpoint, prompt and frame, with the true and the predicted vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.functions.names import ramp_down, ramp_up, stable_hash

SAMPLE = ["checkpoint", "event_id"]


def predictions_view(frames: DataFrame, checkpoints: int = 2, prompts: int = 3) -> DataFrame:
    """Predictions derived from the frames: the true pan and lift plus an offset that a hash of checkpoint, prompt and frame gives."""
    each = frames.select(
        "*",
        (F.col("repo_no") % 3).alias("position"),
        F.expr("repo_no div 3").alias("identity"),
        F.explode(F.expr(f"sequence(0, {checkpoints - 1})")).alias("checkpoint"),
    ).withColumn("prompt", F.explode(F.expr(f"sequence(0, {prompts - 1})")))
    h = stable_hash(F.concat_ws(":", *[F.col(c).cast("string") for c in ("checkpoint", "prompt", "event_id")]))
    out = each.withColumn("h", h).withColumns({"p_pan": F.col("pan") + F.col("h") % 41 - 20, "p_lift": F.col("lift") + F.col("h") % 23 - 11})
    return out.withColumn("dist", F.sqrt((F.col("p_pan") - F.col("pan")) ** 2 + (F.col("p_lift") - F.col("lift")) ** 2))


def joint_errors(p: DataFrame) -> DataFrame:
    """Per checkpoint: MAE of each joint and overall, mean L2, and the worst joint (of equals the first)."""
    e = p.groupBy("checkpoint").agg(F.avg(F.abs(F.col("p_pan") - F.col("pan"))).alias("pan_mae"), F.avg(F.abs(F.col("p_lift") - F.col("lift"))).alias("lift_mae"), F.avg("dist").alias("l2"))
    return e.select("*", ((F.col("pan_mae") + F.col("lift_mae")) / 2).alias("mae"), F.when(F.col("pan_mae") >= F.col("lift_mae"), "pan").otherwise("lift").alias("worst"))


def nearest_prompt(p: DataFrame) -> DataFrame:
    """Per sample: the prompt whose prediction is nearest to the truth (of equals the first), and whether it is the identity's own."""
    n = p.groupBy(*SAMPLE, "identity", "position", "repo_no").agg(F.min_by("prompt", F.struct("dist", "prompt")).alias("nearest"))
    return n.withColumn("correct", F.col("nearest") == F.col("identity"))


def prompt_pairs(p: DataFrame) -> DataFrame:
    """Per sample and pair of prompts a < b: L2 between their predictions. The prompts of a sample are gathered once, no self-join."""
    rows = p.groupBy(*SAMPLE, "identity").agg(F.array_sort(F.collect_list(F.struct("prompt", "p_pan", "p_lift"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter(F.col("x"), lambda b: b["prompt"] > a["prompt"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    out = rows.select(*SAMPLE, "identity", F.explode(pairs).alias("q"))
    gap = F.sqrt((F.col("q.a.p_pan") - F.col("q.b.p_pan")) ** 2 + (F.col("q.a.p_lift") - F.col("q.b.p_lift")) ** 2)
    return out.select(*SAMPLE, "identity", F.col("q.a.prompt").alias("prompt_a"), F.col("q.b.prompt").alias("prompt_b"), gap.alias("l2"))


def offline_score(m: dict[str, Column]) -> Column:
    """Weighted score of six parts: nearest accuracy .30, final accuracy .25, MAE .15, separation .15, smoothness .10, robustness .05."""
    return (
        0.30 * m["nearest"] + 0.25 * m["final"] + 0.15 * ramp_down(m["mae"], 30.0) + 0.15 * ramp_up(m["separation"], 20.0) + 0.10 * ramp_down(m["bend"], 100.0) + 0.05 * ramp_up(m["robust"], 10.0)
    )


def failures(checks: dict[str, Column]) -> Column:
    """The messages of the checks that fail, in order, joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()])), ",")
