"""Edge cases of the operators on hand-made frames."""

import numpy as np
from pyspark.sql import functions as F

from reelbase.functions import names as N
from reelbase.operators import mix, stats
from reelbase.operators import timeseries as T
from reelbase.streaming import guards
from tests.test_playback import stop_after


def made(spark, episodes):
    rows = [(0, e, i, float(v), float(v), 0.0) for e, values in episodes.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "repo_no long, episode_index long, frame_index long, pan double, gripper double, lift double")


def test_smoothing_equals_edge_padding_for_short_episodes(spark):
    rng = np.random.default_rng(0)
    data = {n: rng.integers(0, 100, n).tolist() for n in (1, 2, 3, 5, 9)}
    got = {(r.episode_index, r.frame_index): r.pan_s for r in T.smoothed(made(spark, data), ["pan"], 5).collect()}
    for e, v in data.items():
        w = min(5, len(v) if len(v) % 2 else len(v) - 1)
        padded = np.pad(np.array(v, float), (w - 1) // 2, mode="edge")
        for i in range(len(v)):
            assert abs(got[e, i] - padded[i : i + w].mean()) < 1e-9


def test_truncation_forms_agree(spark):
    df = made(spark, {0: [0, 30, 0, 25, 0, 0], 1: [0] * 8, 2: [30]})
    for mode in ("first", "last"):
        kept = {r.episode_index: r.kept for r in T.truncation(df, mode, 2, 5).collect()}
        cut = {r.episode_index: r["count"] for r in T.truncated(df, mode, 2, 5).groupBy("episode_index").count().collect()}
        assert kept == cut


def test_merged_stats_equal_direct(spark):
    df = made(spark, {0: [1, 2, 3], 1: [10, 20], 2: [5]})
    merged = stats.merged_stats(stats.dimension_stats(df, ["episode_index"], ["pan"]), ["dim"]).first()
    v = np.array([1, 2, 3, 10, 20, 5], float)
    assert np.allclose([merged["mean"], merged["std"], merged["min"], merged["max"], merged["count"]], [v.mean(), v.std(), 1, 20, 6])


def test_chunks_repeat_the_last_value(spark):
    r = T.action_chunks(made(spark, {0: [1, 2]}), "pan", 3).orderBy("frame_index").collect()
    assert [(x.chunk, x.n_valid) for x in r] == [([1.0, 2.0, 2.0], 2), ([2.0, 2.0, 2.0], 1)]


def test_names(spark):
    df = spark.createDataFrame([("a_person_a_left_1",), ("x_middle_y",), ("none",), (None,)], "n string")
    p = N.parsed_repo(F.col("n"), ("person_a",))
    got = [tuple(r) for r in df.select(p["identity"], p["position"], N.slot_of(F.col("n")), N.slot_label(N.slot_of(F.col("n")))).collect()]
    assert got == [("person_a", "left", "left", 0), (None, None, "middle", 1), (None, None, None, -100), (None, None, None, -100)]


def test_filter_text(spark):
    assert sorted(map(tuple, mix.parsed_filter(spark, "r:0,1;q:3,x;;:4").collect())) == [("q", 3), ("r", 0), ("r", 1)]


def test_guard_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ticks = spark.createDataFrame([(r, i, float((i * 7 + r) % 23)) for r in (1, 2) for i in range(20)], "rollout long, step long, value double")
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = guards.action_guard_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")))
    q = stream.writeStream.format("memory").queryName("guarded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    stop_after(q, ticks.count())
    got = sorted(map(tuple, spark.sql("SELECT * FROM guarded").collect()))
    assert got == sorted(map(tuple, guards.action_guard(ticks).collect()))


def test_merged_boxes_and_softmax(spark):
    from reelbase.functions import text as X

    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))])
    r = spark.range(1).select(X.merged_boxes(F.array(box(0, 0, 10, 10), box(1, 1, 30, 30), box(50, 50, 60, 60))).alias("b"), X.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("s")).first()
    assert [tuple(x) for x in r.b] == [(1.0, 1.0, 30.0, 30.0), (50.0, 50.0, 60.0, 60.0)] and r.s == [0.5, 0.5]


def test_renumbering_takes_string_and_several_keys(spark):
    rows = [(r, e, i) for r, e, n in (("b", 5, 2), ("a", 9, 1), ("a", 2, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "repo string, episode long, frame long")
    frames, episodes = T.renumbered(df, ["repo", "episode"], "frame")
    assert [(r.repo, r.episode, r.from_index, r.to_index) for r in episodes.orderBy("episode_no").collect()] == [("a", 2, 0, 3), ("a", 9, 3, 4), ("b", 5, 4, 6)]
    assert [r["index"] for r in frames.orderBy("repo", "episode", "frame").collect()] == list(range(6))
    assert T.renumbered(df.limit(0), ["repo", "episode"], "frame")[0].count() == 0


def test_accented_slugs(spark):
    from reelbase.functions import text as X

    df = spark.createDataFrame([("Zoë  Müller-Ray",), ("plain Name",), (None,)], "n string")
    assert {r.n: r.slug for r in X.with_ascii_slug(df, "n").collect()} == {"Zoë  Müller-Ray": "zoe_muller_ray", "plain Name": "plain_name", None: None}


def test_frames_are_shuffled_once(spark):
    from reelbase.sources.adapters import frames_of

    plan = T.edge_window_stats(frames_of(spark, "/root/testdata/sf0.001"), "pan", 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
