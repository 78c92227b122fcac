"""Per-episode operators on frames. Windows and groups share one key, the episode, so a plan shuffles frames once.

Rows with a null episode form a group of their own; null joint values are skipped by the aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelbase.operators.ranks import before_ranges, met, range_of, spread_bounds
from reelbase.sources.storage import written_once

EPISODE = ("repo_no", "episode_index")


def ordered(keys=EPISODE) -> Window:
    return Window.partitionBy(*keys).orderBy("frame_index")


def whole(keys=EPISODE) -> Window:
    return Window.partitionBy(*keys)


def with_length(df: DataFrame, keys=EPISODE) -> DataFrame:
    return df.withColumn("n", F.count(F.lit(1)).over(whole(keys)))


def edge_window_stats(df: DataFrame, column: str, k: int, keys=EPISODE) -> DataFrame:
    """Mean of the first and last min(k, n) frames, and population deviation of the last."""
    first, last = F.col("frame_index") < k, F.col("n") - F.col("frame_index") <= k
    return with_length(df, keys).groupBy(*keys).agg(F.avg(F.when(first, F.col(column))).alias("start_mean"), F.avg(F.when(last, F.col(column))).alias("end_mean"), F.stddev_pop(F.when(last, F.col(column))).alias("end_std"))


def signed_peak(df: DataFrame, column: str, keys=EPISODE) -> DataFrame:
    """The extremum of larger magnitude (positive on a tie) and the first frame of that magnitude."""
    c = F.col(column)
    return df.groupBy(*keys).agg(F.max(c).alias("hi"), F.min(c).alias("lo"), F.max_by("frame_index", F.struct(F.abs(c), -F.col("frame_index"))).alias("peak_frame")).select(*keys, F.when(F.abs("hi") >= F.abs("lo"), F.col("hi")).otherwise(F.col("lo")).alias("peak"), "peak_frame")


def placement(open_at: float = 20.0, lift_at: float = -30.0) -> Column:
    return (F.col("gripper") >= open_at) & (F.col("lift") >= lift_at)


def placement_match(df: DataFrame, keys=EPISODE) -> DataFrame:
    """First and last frame with an open gripper and a raised arm, null without; and the length."""
    return df.groupBy(*keys).agg(F.min(F.when(placement(), F.col("frame_index"))).alias("first_match"), F.max(F.when(placement(), F.col("frame_index"))).alias("last_match"), F.count(F.lit(1)).alias("length"))


def truncation(df: DataFrame, mode: str = "last", buffer: int = 60, max_frames: int | None = 600, keys=EPISODE) -> DataFrame:
    """Frames to keep of each episode: up to the first match and ``buffer`` more, or up to the last match, never over the cap or the length."""
    m = placement_match(df, keys)
    end = F.col("first_match") + buffer if mode == "first" else F.col("last_match") + 1
    cap = F.col("length") if max_frames is None else F.least(F.lit(max_frames).cast("long"), F.col("length"))
    return m.withColumn("kept", F.when(F.col("last_match").isNull(), cap).otherwise(F.least(end, cap)))


def truncated(df: DataFrame, mode: str = "last", buffer: int = 60, max_frames: int | None = 600, keys=EPISODE) -> DataFrame:
    """The kept frames, by a window over the episode: no join."""
    w = whole(keys)
    end = F.min(F.when(placement(), F.col("frame_index"))).over(w) + buffer if mode == "first" else F.max(F.when(placement(), F.col("frame_index"))).over(w) + 1
    cap = F.lit(max_frames if max_frames is not None else 2**62)
    return df.withColumn("_end", F.least(F.coalesce(end, cap), cap)).where(F.col("frame_index") < F.col("_end")).drop("_end")


def repaired_gripper(c: Column, open_at: float = 20.0, target: float = 55.0) -> Column:
    return F.when(c >= open_at, F.greatest(c, F.lit(target))).otherwise(c)


def smoothed(df: DataFrame, columns: list[str], window: int, keys=EPISODE) -> DataFrame:
    """Centered moving average, clipped to the episode; beyond an end the end value repeats. An even window counts as the next odd one, one below 2 changes nothing.
    Adds <column>_s."""
    out = with_length(df, keys)
    h = max(window, 1) // 2
    half = F.least(F.lit(h), F.expr("cast((n - 1) div 2 as int)"))
    w = ordered(keys)
    for c in columns:
        terms = None
        for k in range(-h, h + 1):
            at = F.when(F.col("frame_index") + k < 0, F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).when(F.col("frame_index") + k >= F.col("n"), F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).otherwise((F.lag(c, -k) if k < 0 else F.lead(c, k)).over(w) if k else F.col(c))
            term = F.when(F.abs(F.lit(k)) <= half, at).otherwise(0.0)
            terms = term if terms is None else terms + term
        out = out.withColumn(f"{c}_s", terms / (2 * half + 1))
    return out.drop("n")


def jerk(df: DataFrame, columns: list[str], fps: int, keys=EPISODE) -> DataFrame:
    """p99 of the norm of the second difference times fps^2; 0 with fewer than three frames."""
    w = ordered(keys)
    second = [(F.col(c) - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)) * fps * fps for c in columns]
    norm = F.sqrt(sum((x * x for x in second[1:]), second[0] * second[0]))
    return df.withColumn("_j", norm).groupBy(*keys).agg(F.coalesce(F.percentile("_j", F.lit(0.99)), F.lit(0.0)).alias("jerk_p99"))


def lag_error(df: DataFrame, column: str, keys=EPISODE) -> DataFrame:
    """p95 of |action - state|, the state being the action of the frame before (the first frame's own)."""
    c = F.col(column)
    return df.withColumn("_d", F.abs(c - F.coalesce(F.lag(column).over(ordered(keys)), c))).groupBy(*keys).agg(F.percentile("_d", F.lit(0.95)).alias("lag_p95"))


def fractional_windows(df: DataFrame, column: str, fps: int, keys=EPISODE) -> DataFrame:
    """Maximum of the first quarter, median of the last quarter, first crossing of 20 in seconds."""
    d = with_length(df, keys)
    return d.groupBy(*keys).agg(F.max(F.when(F.col("frame_index") < F.greatest(F.lit(1), F.floor(F.col("n") * 0.25)), F.col(column))).alias("early_max"), F.percentile(F.when(F.col("frame_index") >= F.floor(F.col("n") * 0.75), F.col(column)), F.lit(0.5)).alias("late_median"), (F.min(F.when(F.col(column) >= 20, F.col("frame_index"))) / fps).alias("first_cross_s"))


def late_windows(df: DataFrame, column: str, extended: str, fps: int, keys=EPISODE) -> DataFrame:
    """q90 and q99 of the last quarter, mean of the last second, and the maximum of ``extended`` over its mean in the first second."""
    late = F.when(F.col("frame_index") >= F.floor(F.col("n") * 0.75), F.col(column))
    start = F.avg(F.when(F.col("frame_index") < fps, F.col(extended)))
    return with_length(df, keys).groupBy(*keys).agg(F.percentile(late, F.lit(0.9)).alias("late_q90"), F.percentile(late, F.lit(0.99)).alias("late_q99"), F.avg(F.when(F.col("n") - F.col("frame_index") <= fps, F.col(column))).alias("last_second_mean"), (F.max(extended) - start).alias("extension"))


def grasp_event(df: DataFrame, delta: float = 10.0, keys=EPISODE) -> DataFrame:
    """Adds ``grasp``: first frame whose gripper differs from the first frame's by more than ``delta``, else 35 % of the length, held to
    15 % .. 50 %; and ``pregrasp``: whether a frame comes no later."""
    w = ordered(keys)
    d = with_length(df, keys).withColumn("_g0", F.first("gripper").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    hit = F.min(F.when(F.abs(F.col("gripper") - F.col("_g0")) > delta, F.col("frame_index"))).over(whole(keys))
    at = lambda f: F.floor(F.col("n") * f)
    return d.withColumn("grasp", F.greatest(at(0.15), F.least(at(0.5), F.coalesce(hit, at(0.35))))).withColumn("pregrasp", F.col("frame_index") <= F.col("grasp")).drop("_g0", "n")


def action_chunks(df: DataFrame, column: str, size: int, keys=EPISODE) -> DataFrame:
    """Adds ``chunk``: the next ``size`` values, the episode's last repeating, and ``n_valid``, how many of them are real."""
    ahead = F.collect_list(column).over(ordered(keys).rowsBetween(0, size - 1))
    return df.withColumn("_a", ahead).withColumn("n_valid", F.size("_a")).withColumn("chunk", F.concat("_a", F.array_repeat(F.element_at("_a", -1), F.lit(size) - F.col("n_valid")))).drop("_a")


def renumbered(df: DataFrame, episode_keys: list[str], order: str, within: list[str] | None = None, fps: int = 30, rows_a_task: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames with new episode_no, frame_no, index, timestamp; episodes with episode_no, length, from_index, to_index, from_time, to_time), numbered in the
    order of the keys, the first key first, whatever their types; with ``within`` each group of those keys starts at 0.

    Lengths are counted once and written. The running index is two-level: episodes are dealt by ranges of their keys, numbered inside a range, and a prefix sum over the ranges
    of a group gives what comes before. No task sees all episodes, nor all of a group. Keys are not null. Frames meet their episodes where the frames of each are; neither is sent to
    all tasks, however few bytes a compressed table says that it has. ``rows_a_task``: frames are dealt by episode to tasks of about so many, else as Spark deals them by bytes."""
    within = within or []
    lengths = written_once(df.groupBy(*episode_keys).agg(F.count(F.lit(1)).alias("length")), "lengths")
    keys = [*within, *[k for k in episode_keys if k not in within]]
    dealt = lengths.withColumn("_p", range_of(lengths, keys, spread_bounds(lengths, keys)))
    totals = dealt.groupBy(*within, "_p").agg(F.sum("length").alias("_f"), F.count(F.lit(1)).alias("_e"))
    numbered = met(dealt, before_ranges(totals, within, {"_f": "_f0", "_e": "_e0"}), [*within, "_p"], "left", small=True)
    w = Window.partitionBy(*within, "_p").orderBy(*episode_keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    episodes = numbered.select(
        *episode_keys,
        "length",
        (zero("_e0") + F.row_number().over(w) - 1).alias("episode_no"),
        (zero("_f0") + F.sum("length").over(w) - F.col("length")).alias("from_index"),
    )
    episodes = episodes.withColumn("to_index", F.col("from_index") + F.col("length"))
    episodes = episodes.withColumns({"from_time": F.col("from_index") / fps, "to_time": F.col("to_index") / fps})
    frame = (F.row_number().over(Window.partitionBy(*episode_keys).orderBy(order)) - 1).cast("long")
    if rows_a_task:
        total = lengths.agg(F.sum("length")).first()[0] or 0
        df = df.repartition(max(1, -(-total // rows_a_task)), *episode_keys)
    frames = df.withColumn("frame_no", frame).join(episodes.select(*episode_keys, "episode_no", "from_index").hint("shuffle_hash"), episode_keys)
    return frames.withColumns({"index": F.col("from_index") + F.col("frame_no"), "timestamp": F.col("frame_no") / fps}), episodes
