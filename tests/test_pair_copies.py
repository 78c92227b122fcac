"""How often a row is sent in all-pairs joins does not grow with the other side: it used to go to every block of 512 of it."""

from pyspark.sql import functions as F

from reelbase.operators import gathers as G


def test_copies_are_bounded(spark):
    side = lambda lo: spark.range(lo, lo + 400).select(F.lit(0).alias("slot"), F.col("id").alias(f"k{lo}"))
    met = G.pairs(side(0), side(1000), ["slot"], side=4)
    assert met.rdd.getNumPartitions() <= 16 * 16  # a task for each cell; there were 100 x 100 cells
    assert met.columns == ["slot", "k0", "k1000"] and met.distinct().count() == 160_000
