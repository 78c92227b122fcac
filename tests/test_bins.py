"""Bins by the exact edges and their centres."""

import numpy as np
from pyspark.sql import functions as F

from reelbase.functions import names as N


def test_bins_equal_digitize_on_every_edge(spark):
    e = np.linspace(-1, 1, 256)
    x = np.concatenate([e, np.nextafter(e, -2), np.nextafter(e, 2), [-3.0, 3.0, 0.123]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").withColumn("b", N.binned(F.col("x")))
    got = df.select("b", N.unbinned(F.col("b")).alias("c")).orderBy("i").collect()
    want = np.digitize(np.clip(x, -1, 1), e)
    assert [r.b for r in got] == want.tolist()
    assert [r.c for r in got] == ((e[:-1] + e[1:]) / 2)[np.clip(want - 1, 0, 254)].tolist()
