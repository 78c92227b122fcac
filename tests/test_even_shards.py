from pyspark.sql import functions as F

from reelbase.operators import mix


def test_a_row_does_not_meet_every_bound(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"))
    made = mix.even_shards(rows, "k", 7)
    assert "lambda" not in made._jdf.queryExecution().toString()
    sizes = made.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("shard").collect()
    assert [r.n for r in sizes] == [2858] + [2857] * 6 and all(a.hi < b.lo for a, b in zip(sizes, sizes[1:], strict=False))
