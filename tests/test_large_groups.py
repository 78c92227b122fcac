"""What must not gather a whole group or table in one Python frame or task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelbase.operators import mix
from reelbase.streaming import guards


def test_guard_carries_its_last_output_over_batches(spark):
    rows = [(r, i, None if (r, i) == (4, 30) else float((i * 7 + (r or 0)) % 23)) for r in (1, 2, None, 4) for i in range(50)]
    ticks = spark.createDataFrame(rows, "rollout long, step long, value double").orderBy(F.rand(3))
    key, most = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    try:
        out = guards.action_guard(ticks)
        assert "FlatMapGroupsIn" not in out._jdf.queryExecution().toString()
        got = {(r.rollout, r.step): r.sent for r in out.collect()}
    finally:
        spark.conf.set(key, most)
    for r in (1, 2, None, 4):
        want = guards.guarded([float("nan") if v is None else v for k, _, v in rows if k == r], 2.0, 0.5, 5.0)[0]
        assert [got[r, i] for i in range(len(want))] == want


def test_even_shards_equal_ntile_without_one_task_for_all(spark):
    for n, shards in ((1000, 7), (3, 5), (0, 2)):
        df = spark.range(n).select((F.col("id") * 37 % 1009).alias("k"), "id")
        want = df.withColumn("shard", F.ntile(shards).over(Window.orderBy("k")) - 1)
        got = mix.even_shards(df, "k", shards)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    made = mix.even_shards(spark.range(1000), "id", 7)
    assert "ntile" not in made._jdf.queryExecution().toString()
    nulls = mix.even_shards(spark.createDataFrame([(None,), ("b",), ("a",)], "k string"), "k", 3)
    assert sorted((r.shard, r.k) for r in nulls.collect()) == [(0, None), (1, "a"), (2, "b")]
