"""Merging shards: failed targets and failed jobs leave what was published."""

import pytest
from pyspark.sql import functions as F

from reelbase.sources import datasets as D

FRAMES = "target string, shard int, episode_index long, frame_index long, pan double"
REPORT = "target string, shard int, error string"


def shards(spark, root, offset, leave=()):
    rows = [(t, k, e, i, offset + 100.0 * k + 10 * e + i) for t in ("a", "b") for k in range(2) if (t, k) not in leave for e in (5, 7) for i in range(3)]
    spark.createDataFrame(rows, FRAMES).write.partitionBy("target", "shard").parquet(root)
    return root


def contents(spark, out):
    return sorted((r.target, r.episode_index, r.frame_index, r["index"], r.pan) for r in spark.read.parquet(out).collect())


def test_failed_and_missing_shards_keep_the_old_target(spark, tmp_path):
    out = str(tmp_path / "out")
    good = spark.createDataFrame([(t, k, None) for t in "ab" for k in range(2)], REPORT)
    told = D.merge_shards(spark, shards(spark, str(tmp_path / "one"), 0.0), good, out)
    assert [r.merged for r in told.collect()] == [True, True]
    old = contents(spark, out)
    assert [r[1:4] for r in old if r[0] == "a"] == [(e, i, 3 * e + i) for e in range(4) for i in range(3)]
    assert [r[4] for r in old if r[0] == "a"] == [100.0 * k + 10 * e + i for k in range(2) for e in (5, 7) for i in range(3)]
    bad = spark.createDataFrame([("a", 0, None), ("a", 1, None), ("b", 0, "out of disk"), ("b", 1, None)], REPORT)
    told = {r.target: r for r in D.merge_shards(spark, shards(spark, str(tmp_path / "two"), 1000.0), bad, out).collect()}
    assert told["a"].merged and not told["b"].merged and told["b"].failed == [0] and told["b"].reason == "1/2 shards failed"
    new = contents(spark, out)
    assert [r for r in new if r[0] == "b"] == [r for r in old if r[0] == "b"] and all(r[4] >= 1000 for r in new if r[0] == "a")
    told = {r.target: r for r in D.merge_shards(spark, shards(spark, str(tmp_path / "three"), 5000.0, leave={("a", 1)}), good, out).collect()}
    assert not told["a"].merged and told["a"].failed == [1] and told["b"].merged
    assert [r for r in contents(spark, out) if r[0] == "a"] == [r for r in new if r[0] == "a"]


def test_a_job_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    good = spark.createDataFrame([(t, k, None) for t in "ab" for k in range(2)], REPORT)
    D.merge_shards(spark, shards(spark, str(tmp_path / "one"), 0.0), good, out)
    old = contents(spark, out)
    plain = D.renumbered

    def broken(*args, **kw):
        frames, episodes = plain(*args, **kw)
        return frames.withColumn("pan", F.when((F.col("target") == "b") & (F.col("frame_no") == 2), F.raise_error(F.lit("lost"))).otherwise(F.col("pan"))), episodes

    monkeypatch.setattr(D, "renumbered", broken)
    with pytest.raises(Exception, match="lost"):
        D.merge_shards(spark, shards(spark, str(tmp_path / "two"), 1000.0), good, out)
    assert contents(spark, out) == old


def test_frames_are_merged_by_as_many_tasks_as_their_number_asks_for(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "FRAMES_A_TASK", 3, raising=False)
    out, root = str(tmp_path / "out"), shards(spark, str(tmp_path / "one"), 0.0)
    D.merge_shards(spark, root, spark.createDataFrame([(t, k, None) for t in "ab" for k in range(2)], REPORT), out)
    assert len(contents(spark, out)) == 24 and spark.read.parquet(out).select(F.input_file_name()).distinct().count() > 3
    frames, _ = D.renumbered(spark.read.parquet(root), ["target", "shard", "episode_index"], "frame_index", within=["target"])
    joins = [x for x in frames._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "Inner" in x]
    assert len(joins) == 1 and "BroadcastHashJoin" not in joins[0]  # few bytes of files can be very many frames
