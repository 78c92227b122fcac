"""Joins and gathers between frames, episodes, tasks and reference tables, and picks of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelbase.operators.ranks import met, ranked, runs_of
from reelbase.operators.timeseries import EPISODE, ordered, renumbered, whole, with_length
from reelbase.sources.storage import written_once


def by_row_range(frames: DataFrame, episodes: DataFrame, repo: str = "repo_id") -> DataFrame:
    """Frames that carry only a running ``index``, joined to the episode with dataset_from_index <= index < dataset_to_index. Instead of comparing every
    frame with every episode, the starts are merged into the frames' order and the last start seen is taken: one shuffle by repo and range."""
    width = 65536
    block = F.floor(F.col("index") / width)
    # an episode is listed in every block of indexes that it touches
    spans = episodes.withColumn("_b", F.explode(F.sequence(F.floor(F.col("dataset_from_index") / width), F.floor((F.col("dataset_to_index") - 1) / width))))
    spans = spans.where("dataset_to_index > dataset_from_index")
    within = (F.col("index") >= F.col("dataset_from_index")) & (F.col("index") < F.col("dataset_to_index"))
    return frames.withColumn("_b", block).join(spans, [repo, "_b"]).where(within).drop("_b")


def recipe_frames(frames: DataFrame, recipe: DataFrame) -> DataFrame:
    """Frames of the recipe's repos with its ``split`` tag; a source with a null ``episodes`` list gives all its episodes. The recipe is a short table."""
    both = frames.join(F.broadcast(recipe), "repo_no")
    return both.where(F.col("episodes").isNull() | F.array_contains("episodes", F.col("episode_index"))).drop("episodes")


def grid_difference(observed: DataFrame, a: list[str], b: list[str], names: tuple[str, str] = ("identity", "position")) -> DataFrame:
    """Cells of the expected grid that are missing, and observed cells that are not in it: (names, state)."""
    spark = observed.sparkSession
    expected = spark.createDataFrame([(x, y) for x in a for y in b], f"{names[0]} string, {names[1]} string")
    seen = observed.select(*names).distinct()
    missing = expected.join(seen, list(names), "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(seen.join(F.broadcast(expected), list(names), "left_anti").withColumn("state", F.lit("unexpected")))


def curated(pool: DataFrame, names: list[str], key: str, held_out: Column) -> DataFrame:
    """The named entries of a pool with their place in the list as ``rank``; a name that is missing or held out is an error."""
    wanted = pool.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"{key} string, rank int")
    found = F.broadcast(wanted).join(pool.withColumns({"_held": held_out, "_there": F.lit(True)}), key, "left")
    fault = F.when(F.col("_there").isNull(), F.concat(F.lit("not in the pool: "), key)).when(F.col("_held"), F.concat(F.lit("held out: "), key))
    ok = F.when(fault.isNotNull(), F.raise_error(fault).cast("int")).otherwise(F.col("rank"))
    return found.withColumn("rank", ok).drop("_held", "_there")


def nearest_within(value: Column, centroids: dict[str, float], tolerance: float) -> Column:
    """The label of the nearest reference at most ``tolerance`` away, of equals the first listed; else null."""
    best = F.array_min(F.array(*[F.struct(F.abs(value - F.lit(c)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, c) in enumerate(centroids.items())]))
    return F.when(best["d"] <= tolerance, best["n"])


def delta_gather(frames: DataFrame, column: str, deltas: list[int], overrides: DataFrame | None = None, keys=EPISODE) -> DataFrame:
    """Adds ``gathered``: the values at the given frame offsets, held to both ends of the episode. A sparse table of overrides (keys, frame_index, value)
    replaces values first."""
    if overrides is not None:
        patched = frames.join(overrides.withColumnRenamed("value", "_v"), [*keys, "frame_index"], "left")
        frames = patched.withColumn(column, F.coalesce("_v", column)).drop("_v")
    w = ordered(keys)
    low, high = min(0, *deltas), max(0, *deltas)
    near = F.collect_list(column).over(w.rowsBetween(low, high))
    place = F.col("frame_index")
    before = F.least(place, F.lit(-low))  # how many frames of the window lie before this one
    at = [F.greatest(F.lit(0), F.least(F.col("n") - 1, place + d)) - place + before for d in deltas]
    out = with_length(frames, keys).withColumn("_near", near)
    return out.withColumn("gathered", F.array(*[F.element_at("_near", (x + 1).cast("int")) for x in at])).drop("_near", "n")


def first_frame_after(frames: DataFrame, column: str, pregrasp: str = "pregrasp", keys=EPISODE) -> DataFrame:
    """Adds <column>_seen: the frame's own value up to the event, the episode's first value after it."""
    first = F.first(column).over(ordered(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return frames.withColumn(f"{column}_seen", F.when(F.col(pregrasp), F.col(column)).otherwise(first))


def compared_rows(frames: DataFrame, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Repos of one slot (repo_no % 3) compared row by row, by their position in the repo: repo_a < repo_b, rows, equal rows, close rows, max and mean
    absolute difference, mean L2 difference. Every repo meets the two or few others of its slot, so rows grow linearly."""
    numbered, _ = renumbered(frames.select("repo_no", "episode_index", "frame_index", *columns), ["repo_no", "episode_index"], "frame_index", within=["repo_no"])
    placed = written_once(numbered.select("repo_no", (F.col("repo_no") % 3).alias("slot"), F.col("index").alias("row"), *columns), "placed-rows")
    a = placed.select("slot", "row", F.col("repo_no").alias("repo_a"), F.array(*columns).alias("x"))
    b = placed.select("slot", "row", F.col("repo_no").alias("repo_b"), F.array(*columns).alias("y"))
    both = a.join(b, ["slot", "row"]).where("repo_a < repo_b").withColumn("d", F.zip_with("x", "y", lambda p, q: F.abs(p - q)))
    top = F.array_max("d")
    total = F.aggregate("d", F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate("d", F.lit(0.0), lambda s, v: s + v * v))
    return both.groupBy("repo_a", "repo_b").agg(
        F.count(F.lit(1)).alias("rows_compared"),
        F.count_if(top == 0).alias("rows_equal"),
        F.count_if(top <= tolerance).alias("rows_close"),
        F.max(top).alias("max_diff"),
        (F.sum(total) / (F.count(F.lit(1)) * len(columns))).alias("mean_diff"),
        F.avg(norm).alias("mean_l2"),
    )


CELL = ["_i", "_j"]


def cells(a: DataFrame, b: DataFrame, on: list[str], side: int = 512, most: int = 2000, by: tuple[str, str] | None = None, copies: int = 16, widest: int = 16384) -> DataFrame:
    """Every row of ``a`` with every row of ``b`` of equal keys, where few keys hold all rows and the pairs are what is wanted, with the cell ``_i``, ``_j`` in which the two meet. Both sides are
    written and dealt into blocks of ``side`` rows of a key, by hash, or with ``by`` by the place (from 0) that a column of each side counts. A block of ``a`` meets a block of ``b`` in a cell. A row
    is sent to each block of the other side: blocks grow with the table, up to ``widest`` rows, so that it is sent ``copies`` times at most and what is shuffled follows the sides, not the pairs.
    Cells are dealt to at most ``most`` tasks by a fixed number, which adaptive planning leaves alone: it would join them all into one task, for their input is small. The result stays dealt by
    [*on, _i, _j], so groups that have these keys are made without a shuffle."""
    a, b = written_once(a, "pairs-left"), written_once(b, "pairs-right")
    names = [c for c in b.columns if c not in on]
    count = lambda df, at: df.groupBy(*on).agg((F.max(at) + 1 if at else F.count(F.lit(1))).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    place_a, place_b = by or (None, None)
    (most_a, keys), (most_b, _) = count(a, place_a), count(b, place_b)
    most_a, most_b = most_a or 1, most_b or 1
    width_a, width_b = (min(widest, max(side, -(-k // copies))) for k in (most_a, most_b))
    m, n = -(-most_a // width_a), -(-most_b // width_b)
    tasks = max(1, min(most, keys * m * n))
    block = lambda df, k, width, at: (F.floor(F.col(at) / width) if at else F.pmod(F.xxhash64(*df.columns), F.lit(k))).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cell = [*on, *CELL]
    left = a.withColumn("_i", block(a, m, width_a, place_a)).withColumn("_j", every(n)).repartition(tasks, *cell)
    right = b.withColumn("_j", block(b, n, width_b, place_b)).withColumn("_i", every(m)).repartition(tasks, *cell)
    return left.join(right.hint("shuffle_hash"), cell).select(*a.columns, *names, *CELL)


def pairs(a: DataFrame, b: DataFrame, on: list[str], side: int = 512, most: int = 2000) -> DataFrame:
    """The pairs of :func:`cells`, without their cell."""
    return cells(a, b, on, side, most).drop(*CELL)


def window_from(lengths: DataFrame, size: int, share: float = 0.25, keys=EPISODE, length: str = "n") -> DataFrame:
    """Consecutive frames of each episode, from ``share`` of it on: ``size`` of them, two at least, as far as it goes."""
    start = F.floor(F.col(length) * share)
    last = F.least(F.col(length), start + max(2, size)) - 1
    return lengths.where(F.col(length) > 0).select(*keys, F.explode(F.sequence(start, last)).alias("frame_index"))


def fractional_picks(lengths: DataFrame, k: int, length: str = "n") -> DataFrame:
    """Frames at fractions of the episode, floor((n - 1) * f), each once: one at .88, two at .5 and .88, else evenly from .25 to .9. Phase final from .75."""
    shares = [0.88] if k == 1 else [0.5, 0.88] if k == 2 else [0.25 + 0.65 * i / (k - 1) for i in range(k)]
    rows = lengths.withColumn("f", F.explode(F.array(*map(F.lit, shares)))).withColumn("frame_index", F.floor((F.col(length) - 1) * F.col("f")))
    first = rows.groupBy(*lengths.columns, "frame_index").agg(F.min("f").alias("f"))
    return first.withColumn("phase", F.when(F.col("f") >= 0.75, "final").otherwise("early")).drop("f")


def even_positions(rows: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """At most k rows of each group, evenly spaced over the order: positions round(i * (n - 1) / (k - 1)), half to even, each once."""
    stored = written_once(rows, "even-positions")
    counts = stored.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    placed = met(ranked(stored, group, order, "_r"), counts, group)
    # row r is taken when some i gives it; only i near r * (k - 1) / (n - 1) can
    near = F.floor(F.col("_r") * (k - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hits = [(near + d >= 0) & (near + d <= k - 1) & (F.bround((near + d) * (F.col("_n") - 1) / F.lit(float(max(k - 1, 1)))) == F.col("_r")) for d in (-1, 0, 1, 2)]
    return placed.where((F.col("_n") <= k) | (hits[0] | hits[1] | hits[2] | hits[3])).drop("_r", "_n")


def strided_frames(lengths: DataFrame, k: int, length: str = "n") -> DataFrame:
    """k frames of each episode at int(i * (n - 1) / (k - 1)), each once."""
    at = F.floor(F.col("i") * (F.col(length) - 1) / max(k - 1, 1))
    return lengths.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("frame_index", at).drop("i").distinct()


def episode_end(frames: DataFrame, repo: str = "repo_no", order: tuple[str, ...] = ("episode_index", "frame_index")) -> DataFrame:
    """Adds ``run_end``: the position after the last frame of the run of equal episodes that a frame lies in. Runs are found from changes."""
    return runs_of(written_once(frames, "runs"), [repo], list(order), "episode_index")


def seam_distance(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """L2 between the last vector of each episode of ``a`` and the first of each episode of ``b`` of one slot: slot, a_ep, b_ep, distance. The two
    tables are episode ends, a row per episode; pairs are wanted in full, they are the plan."""
    last = a.groupBy("slot", "episode_index").agg(F.max_by(F.array(*columns), "frame_index").alias("x")).withColumnRenamed("episode_index", "a_ep")
    first = b.groupBy("slot", "episode_index").agg(F.min_by(F.array(*columns), "frame_index").alias("y")).withColumnRenamed("episode_index", "b_ep")
    away = [F.col("x")[i] - F.col("y")[i] for i in range(len(columns))]  # written out, so that it compiles
    gap = F.sqrt(sum((v * v for v in away), F.lit(0.0)))
    return pairs(last, first, ["slot"]).select("slot", "a_ep", "b_ep", gap.alias("distance"))


def bridge(ends: DataFrame, n: int, hold: bool = False, dims: int | None = None) -> DataFrame:
    """n rows between the vectors ``x`` and ``y`` of each row, at t = (i + 1) / (n + 1); with ``hold`` x repeats. Adds step and vector. Vectors known to have ``dims`` entries are
    written out, which compiles."""
    t = (F.col("step") + 1) / (n + 1)
    between = F.array(*[F.col("x")[i] + (F.col("y")[i] - F.col("x")[i]) * t for i in range(dims)]) if dims else F.zip_with("x", "y", lambda p, q: p + (q - p) * t)
    return ends.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("vector", F.col("x") if hold else between)


def contiguity(episodes: DataFrame, frames: DataFrame) -> DataFrame:
    """Per repo: whether episodes tile (each begins where the one before ends), lengths fit, and frame numbers run from 0 to n - 1."""
    w = Window.partitionBy("repo_no").orderBy("episode_index")
    tiles = episodes.withColumn("ok", F.coalesce(F.lag("to_index").over(w), F.lit(0)) == F.col("from_index"))
    e = tiles.groupBy("repo_no").agg(F.bool_and("ok").alias("tiled"), F.bool_and(F.expr("to_index - from_index = length")).alias("lengths"))
    runs = frames.withColumn("r", F.row_number().over(ordered()) - 1).groupBy("repo_no").agg(F.bool_and(F.col("r") == F.col("frame_index")).alias("numbered"))
    return e.join(runs, "repo_no")


def contiguous(frames: DataFrame, episodes: DataFrame, repo: str = "repo_no", fps: int = 30) -> DataFrame:
    """Per repo the number of episodes that break a rule: ``gaps`` (does not begin where the one before ends, the first at 0), ``lengths`` (to - from differs from the length or from the frames that are there), ``numbers`` (frame numbers do
    not run from 0), ``indexes`` (a frame's index is not its episode's begin plus its number) and ``times`` (a timestamp is not number / fps, within 1e-4; missing ones are passed over). ``frames``: repo, episode_index, frame_index, index,
    timestamp; ``episodes``: repo, episode_index, length, from_index, to_index. The one before is found by its place among all of the repo's, so no task sees a repo whole."""
    keys = [repo, "episode_index"]
    placed = written_once(ranked(episodes, [repo], ["episode_index"], "_k"), "placed-episodes")
    before = placed.select(repo, (F.col("_k") + 1).alias("_k"), F.col("to_index").alias("_end"))
    begins = placed.join(before, [repo, "_k"], "left")
    # an episode's numbers run from 0 to n - 1 if there are n different ones and the ends fit
    f = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("frame_index").alias("_d"), F.min("frame_index").alias("_lo"), F.max("frame_index").alias("_hi"), F.min(F.col("index") - F.col("frame_index")).alias("_ilo"), F.max(F.col("index") - F.col("frame_index")).alias("_ihi"),
        F.max(F.abs(F.col("timestamp") - F.col("frame_index") / fps)).alias("_t"),
    )
    rules = {"gaps": "from_index = coalesce(_end, 0)", "lengths": "to_index - from_index = length AND length = _n", "numbers": "_d = _n AND _lo = 0 AND _hi = _n - 1", "indexes": "_ilo = from_index AND _ihi = from_index", "times": "_t <= 1e-4"}
    return begins.join(f, keys, "left").groupBy(repo).agg(*[F.count_if(F.expr(f"NOT coalesce({rule}, false)")).alias(name) for name, rule in rules.items()])


def flips_once(frames: DataFrame, flag: str, at: str, keys=EPISODE) -> DataFrame:
    """Per episode: how often the flag changes, and whether it does exactly once, at ``at`` + 1 (never, if that lies beyond the end)."""
    before = F.lag(flag).over(ordered(keys))
    changed = frames.withColumn("_c", F.coalesce(before != F.col(flag), F.lit(False)))
    s = changed.groupBy(*keys).agg(F.count_if("_c").alias("changes"), F.min(F.when(F.col("_c"), F.col("frame_index"))).alias("_at"), F.max(at).alias("_want"), F.max("frame_index").alias("_end"))
    once = F.when(F.col("_want") + 1 > F.col("_end"), F.col("changes") == 0).otherwise((F.col("changes") == 1) & (F.col("_at") == F.col("_want") + 1))
    return s.select(*keys, "changes", once.alias("once"))


def sparse_overrides(before: DataFrame, after: DataFrame, columns: list[str], keys=EPISODE) -> DataFrame:
    """The frames whose vector changed by more than 1e-6 (L2), with the new vector."""
    old = before.select(*keys, "frame_index", F.array(*columns).alias("_x"))
    new = after.select(*keys, "frame_index", F.array(*columns).alias("vector"))
    moved = F.sqrt(F.aggregate(F.zip_with("_x", "vector", lambda p, q: p - q), F.lit(0.0), lambda s, v: s + v * v))
    return new.join(old, [*keys, "frame_index"]).where(moved > 1e-6).drop("_x")


def trajectory_errors(frames: DataFrame, truth: str, predicted: str, gripper: str = "gripper", keys=EPISODE) -> DataFrame:
    """Per episode: MAE, ranges, Pearson's r (0 where either side is constant) and the MAE after the frame of the least gripper value."""
    low = F.min_by("frame_index", F.struct(gripper, "frame_index")).over(whole(keys))
    d = frames.withColumn("_low", low).withColumn("_e", F.abs(F.col(truth) - F.col(predicted)))
    flat = (F.stddev_pop(truth) < 1e-9) | (F.stddev_pop(predicted) < 1e-9)
    span = lambda c: F.max(c) - F.min(c)
    return d.groupBy(*keys).agg(
        F.avg("_e").alias("mae"),
        span(truth).alias("truth_range"),
        span(predicted).alias("predicted_range"),
        F.when(flat, 0.0).otherwise(F.corr(truth, predicted)).alias("r"),
        F.avg(F.when(F.col("frame_index") > F.col("_low"), F.col("_e"))).alias("mae_after_grasp"),
    )
