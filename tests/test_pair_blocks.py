"""All pairs of a hot key are made by many tasks, whatever adaptive planning thinks of their small input."""

from pyspark.sql import functions as F

from reelbase.operators import gathers as G
from reelbase.queries.base import compiled_round


def test_hot_key_is_many_tasks(spark):
    side = lambda lo: spark.range(lo, lo + 1500).select(F.lit(0).alias("slot"), F.col("id").alias("episode_index"), F.lit(0).alias("frame_index"), (F.col("id") % 7).cast("double").alias("pan"), F.lit(1.0).alias("lift"))
    seams = G.seam_distance(side(0), side(5000), ["pan", "lift"])
    by_task = [r["count"] for r in seams.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert sum(by_task) == 1500 * 1500 and max(by_task) < 0.6 * 1500 * 1500
    assert seams.select("a_ep", "b_ep").distinct().count() == 1500 * 1500
    assert seams.where(F.abs(F.col("distance") - F.abs(F.col("a_ep") % 7 - F.col("b_ep") % 7)) > 1e-9).count() == 0


def test_bridge_written_out(spark):
    ends = spark.createDataFrame([(1, [0.0, 3.0], [6.0, -3.0]), (2, [1.0, None], [1.0, 2.0])], "k int, x array<double>, y array<double>")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(G.bridge(ends, 5, dims=2)) == rows(G.bridge(ends, 5)) and rows(G.bridge(ends, 5, hold=True, dims=2)) == rows(G.bridge(ends, 5, hold=True))


def test_compiled_round(spark):
    values = [0.0, -0.0, 1 / 3, -2 / 3, 2.5, -2.5, 12.3456785, 1e300, -1e12 - 0.1234567, float("inf"), None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", compiled_round(F.col("v"), 6).alias("r"), F.round("v", 6).alias("want")).collect()
    assert [r.r for r in got] == [r.want for r in got]
    assert str(spark.sql("SELECT double('NaN') AS v").select(compiled_round(F.col("v"), 6)).first()[0]) == "nan"
