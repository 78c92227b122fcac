"""The full label audit: twelve metrics of each dataset, given as a table of rules over long rows, and verdicts on labels, on quality and overall.

Datasets lie in collections; positions are calibrated from each collection's own data, so a collection whose positions lie too close gives advice only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.functions.names import repo_form
from reelbase.operators.stats import exact_quantiles
from reelbase.operators.timeseries import with_length
from reelbase.sources.adapters import JOINTS
from reelbase.sources.storage import written_once

KEYS = ["collection", "repo_id"]
EPISODE = [*KEYS, "episode_index"]

_TO_LEFT, _TO_RIGHT = "sign(c_left - c_middle)", "sign(c_right - c_middle)"


def _excursion(to: str, reach: str) -> str:
    """How far the arm went beyond the middle to one side, as a share of that side's reach."""
    return f"greatest(0D, {to} * if({to} < 0, lo, hi) - {to} * c_middle) / greatest({reach}, 1e-6D)"


#: metric, level, whether it needs a position in the dataset's name, whether it judges episodes, what must hold. Thresholds are fixed values.
RULES = (
    ("m1", "label", True, True, "nearest = position"),
    ("m2", "quality", True, True, "CASE position WHEN 'left' THEN peak >= c_middle + 0.6D * (c_left - c_middle) WHEN 'right' THEN peak <= c_middle + 0.6D * (c_right - c_middle) ELSE abs(peak - c_middle) <= 0.3D * least(reach_left, reach_right) END"),
    ("m3", "quality", True, True, f"CASE position WHEN 'left' THEN (peak - pan_start) * {_TO_LEFT} > 5 WHEN 'right' THEN (peak - pan_start) * {_TO_RIGHT} > 5 ELSE abs(peak - pan_start) < 25 END"),
    ("m4", "quality", True, True, f"CASE position WHEN 'left' THEN {_excursion(_TO_RIGHT, 'reach_right')} WHEN 'right' THEN {_excursion(_TO_LEFT, 'reach_left')} ELSE greatest({_excursion(_TO_LEFT, 'reach_left')}, {_excursion(_TO_RIGHT, 'reach_right')}) END < 1"),
    ("m5", "quality", False, True, "greatest(gripper_start, gripper_end) >= 5"),
    ("m6", "quality", False, True, "abs(wrist_end - wrist_start) > 5"),
    ("m7", "quality", False, True, "pan_end_std < 5"),
    ("m8", "label", False, False, "forall(tasks, t -> contains(lower(t), expected))"),
    ("m9", "label", False, False, "NOT exists(tasks, t -> exists(forbidden, w -> contains(lower(t), w)))"),
    ("m10", "label", False, False, "size(tasks) = 1"),
    ("m11", "label", False, False, "form IS NOT NULL"),
    ("m12", "label", False, False, "version_ok AND fps_ok AND total_frames <=> frames AND NOT invalid"),
)


def episode_measures(frames: DataFrame, start: int, end: int) -> DataFrame:
    """One row per episode: extremes and signed peak of the pan joint, means of the first ``start`` and last ``end`` frames, and whether a value is missing or not finite."""
    first, last = F.col("frame_index") < start, F.col("n") - F.col("frame_index") <= end
    mean = lambda c, w: F.avg(F.when(w, F.col(c)))
    bad = F.lit(False)
    for j in JOINTS:
        bad = bad | F.col(j).isNull() | F.isnan(j) | (F.abs(F.col(j)) == float("inf"))
    e = with_length(frames, EPISODE).groupBy(*EPISODE, "n").agg(
        F.max("pan").alias("hi"), F.min("pan").alias("lo"), F.stddev_pop(F.when(last, F.col("pan"))).alias("pan_end_std"), mean("pan", first).alias("pan_start"),
        mean("wrist_flex", first).alias("wrist_start"), mean("wrist_flex", last).alias("wrist_end"), mean("gripper", first).alias("gripper_start"), mean("gripper", last).alias("gripper_end"), F.bool_or(bad).alias("invalid"),
    )
    return e.withColumn("peak", F.expr("if(abs(hi) >= abs(lo), hi, lo)"))


def centroids(episodes: DataFrame, least_gap: float) -> DataFrame:
    """Per collection the median signed peak of each position, from datasets of the form v2 without missing values, and whether those of neighbours are ``least_gap`` apart. Without one of the
    positions nothing is separable."""
    some = episodes.where("form = 'v2' AND NOT invalid")
    q = exact_quantiles(some, ["collection", "position"], "peak", (0.5,))
    one = q.groupBy("collection").agg(*[F.max(F.when(F.col("position") == p, F.col("q0"))).alias(f"c_{p}") for p in ("left", "middle", "right")])
    one = one.withColumns({"reach_left": F.expr("abs(c_left - c_middle)"), "reach_right": F.expr("abs(c_right - c_middle)")})
    gaps = "transform(array(0, 1), i -> array_sort(array(c_left, c_middle, c_right))[i + 1] - array_sort(array(c_left, c_middle, c_right))[i])"
    return one.withColumn("separable", F.expr(f"coalesce(array_min({gaps}) >= {least_gap} AND c_left + c_middle + c_right IS NOT NULL, false)"))


def _words(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x.lower()) for kv in table.items() for x in kv])


def metrics(frames: DataFrame, tasks: DataFrame, info: DataFrame, identities: dict[str, str], markers: dict[str, str], start: int = 10, end: int = 30, pass_at: float = 0.8, least_gap: float = 5.0, version: str = "v3.0", fps: int = 30) -> DataFrame:
    """Long rows: collection, repo_id, form, position, separable, metric, level, share, passed.

    ``frames``: collection, repo_id, episode_index, frame_index and the joints; ``tasks``: collection, repo_id, task; ``info``: collection, repo_id, codebase_version, fps, total_frames. ``identities`` gives
    the name that a text must mention for each identity of a dataset's name, ``markers`` that of each position, for datasets without an identity. A metric that does not
    apply has no row: those on positions without a position in the name, those on texts for a name of no known form. An episode with a missing or infinite value passes none of its metrics. Without texts, m10
    fails; without info, m12 does. A dataset without frames is not audited."""
    named = {"form": "form", "identity": "identity", "position": "position"}
    parts = repo_form(F.col("repo_id"), tuple(identities))
    e = episode_measures(frames, start, end).withColumns({k: parts[v] for k, v in named.items()})
    e = written_once(e, "measures")  # a row per episode, read for the centroids and to be judged
    c = centroids(e, least_gap)
    near = "CASE WHEN abs(peak - c_left) <= abs(peak - c_middle) AND abs(peak - c_left) <= abs(peak - c_right) THEN 'left' WHEN abs(peak - c_right) <= abs(peak - c_middle) THEN 'right' ELSE 'middle' END"
    # per dataset and per episode: the collection's centroids come after episodes are one row each; collections may be as many as datasets, so no side is forced
    judged = e.join(c, "collection", "left").withColumn("nearest", F.expr(near))
    of_episodes = [(m, cond) for m, _, _, by_episode, cond in RULES if by_episode]
    per_repo = judged.groupBy(*KEYS, *named, "separable").agg(
        *[F.avg(F.expr(f"cast(coalesce({cond}, false) AND NOT invalid AS int)")).alias(m) for m, cond in of_episodes], F.sum("n").alias("frames"), F.bool_or("invalid").alias("invalid")
    )
    texts = tasks.groupBy(*KEYS).agg(F.collect_set("task").alias("tasks"))
    meta = info.groupBy(*KEYS).agg((F.max("codebase_version") == version).alias("version_ok"), (F.max("fps") == fps).alias("fps_ok"), F.max("total_frames").alias("total_frames"))
    d = per_repo.join(texts, KEYS, "left").join(meta, KEYS, "left").withColumn("tasks", F.coalesce("tasks", F.expr("cast(array() as array<string>)")))
    for_person, for_place = _words(identities), _words(markers)
    key = F.coalesce("identity", "position")
    d = d.withColumns({"expected": F.when(F.col("identity").isNotNull(), for_person[F.col("identity")]).otherwise(for_place[F.col("position")]), "_all": F.when(F.col("identity").isNotNull(), F.map_values(for_person)).otherwise(F.map_values(for_place))})
    d = d.withColumn("forbidden", F.when(key.isNotNull(), F.expr("filter(_all, w -> w <> expected)")))
    d = d.withColumns({m: F.expr(f"cast({cond} AS double)") if m in ("m8", "m9") else F.expr(f"cast(coalesce({cond}, false) AS double)") for m, _, _, by_episode, cond in RULES if not by_episode})
    names = [r[0] for r in RULES]
    long = d.select(*KEYS, "form", "position", F.coalesce("separable", F.lit(False)).alias("separable"), *names).unpivot([*KEYS, "form", "position", "separable"], names, "metric", "share")
    rules = frames.sparkSession.createDataFrame([(m, level, by_place, pass_at if by_episode else 1.0) for m, level, by_place, by_episode, _ in RULES], "metric string, level string, by_place boolean, least double")
    applies = "share IS NOT NULL AND (NOT by_place OR position IS NOT NULL)"
    return long.join(F.broadcast(rules), "metric").where(applies).select(*KEYS, "form", "position", "separable", "metric", "level", "share", (F.col("share") >= F.col("least")).alias("passed"))  # twelve rules


def verdicts(long: DataFrame) -> DataFrame:
    """One row per dataset: m1 .. m12 (null where a metric does not apply), ``label`` and ``quality`` (PASS or FAIL), and ``overall``: ADVISORY if the name has a position and positions cannot be told apart, FAIL
    for a failed label metric, WARN for a failed quality metric, else PASS."""
    failed = lambda level: F.coalesce(F.bool_or(~F.col("passed") & (F.col("level") == level)), F.lit(False))
    wide = long.groupBy(*KEYS, "position", "separable").agg(*[F.max(F.when(F.col("metric") == r[0], F.col("passed"))).alias(r[0]) for r in RULES], failed("label").alias("_l"), failed("quality").alias("_q"))
    overall = F.expr("CASE WHEN NOT separable AND position IS NOT NULL THEN 'ADVISORY' WHEN _l THEN 'FAIL' WHEN _q THEN 'WARN' ELSE 'PASS' END")
    word = lambda c: F.when(F.col(c), "FAIL").otherwise("PASS")
    return wide.select(*KEYS, "position", *[r[0] for r in RULES], word("_l").alias("label"), word("_q").alias("quality"), overall.alias("overall"))
