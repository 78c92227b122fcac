"""Positions, runs and quantiles of groups of very unequal size, against windows and numpy."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelbase.operators import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """A group with nine tenths of the rows, a few small ones and a null one."""
    i = F.col("id")
    g = F.when(i % 10 != 0, "hot").when(i % 70 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), (i % 17).cast("string")))
    df = spark.range(20_000).select(i, g.alias("g"), F.xxhash64("id").alias("k"), (F.xxhash64(i + 7) % 1000 / 8).alias("x"), F.floor(i / 37).alias("e"))
    return df.repartition(5).cache()


def test_ranked_equals_row_number(skewed):
    for group, order in ((["g"], ["k"]), ([], ["k"]), (["g"], ["e", "k"])):
        want = skewed.withColumn("rank", (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("long"))
        got = ranks.ranked(skewed, group, order)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_task_has_a_large_part_of_a_hot_group(skewed):
    assert ranks.largest_task_share(skewed, ["g"], ["k"]) < 0.02
    plan = ranks.ranked(skewed, ["g"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(g" in plan.lower() and "_p#" in plan


def test_ranges_do_not_depend_on_the_layout(skewed):
    assert ranks.spread_bounds(skewed, ["g", "k"]) == ranks.spread_bounds(skewed.repartition(9, "x"), ["g", "k"])


@pytest.mark.parametrize("few", [0, 500_000])
def test_quantiles_equal_numpy(skewed, few, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", few)
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)
    rows = skewed.withColumn("x", F.when(F.col("id") % 11 != 0, F.col("x")))
    got = {r.g: r for r in ranks.selected_quantiles(rows, ["g"], "x", shares).collect()}
    by = {}
    for r in rows.collect():
        if r.x is not None:
            by.setdefault(r.g, []).append(r.x)
    assert set(got) == set(by)
    for g, v in by.items():
        assert np.allclose([got[g][f"q{k}"] for k in range(len(shares))], np.quantile(v, shares), rtol=0, atol=1e-9)
    whole = ranks.selected_quantiles(rows, [], "x", (0.5,)).first()
    assert whole.q0 == np.quantile([x for v in by.values() for x in v], 0.5)


def test_small_and_empty(spark):
    schema = "g string, k long, x double"
    empty = spark.createDataFrame([], schema)
    assert ranks.ranked(empty, ["g"], ["k"]).count() == 0 and ranks.selected_quantiles(empty, ["g"], "x", (0.5,)).count() == 0 and ranks.runs_of(empty, ["g"], ["k"], "x").count() == 0
    one = spark.createDataFrame([("a", None, None), (None, 1, 2.0), ("a", 3, 1.0)], schema)
    assert sorted(map(str, ranks.ranked(one, ["g"], ["k"]).collect())) == sorted(map(str, one.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).collect()))


@pytest.mark.parametrize("ranges", [2, 7, 128])
def test_runs_over_ranges(spark, ranges, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 1)
    rng = np.random.default_rng(ranges)
    rows = []
    for g, sizes in (("hot", [900, 1, 1, 300, 50, 2, 700]), ("a", [3, 3]), ("b", [1]), (None, [40, 1, 40])):
        at = 0
        for n, size in enumerate(sizes):
            value = None if n % 3 == 2 else n % 2
            for _ in range(size):
                rows.append((g, at, value))
                at += 1
    want, ends = [], {}
    for i in range(len(rows) - 1, -1, -1):
        g, at, v = rows[i]
        same = i + 1 < len(rows) and rows[i + 1][0] == g and rows[i + 1][2] == v
        ends[i] = ends[i + 1] if same else at + 1
        want.append((g, at, v, ends[i]))
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "g string, k long, v int")
    got = ranks.runs_of(df, ["g"], ["k"], "v", ranges=ranges)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_keys_of_many_types(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 1)
    kinds = ["cast(null as int)", "id", "cast(id as string)", "concat('o''x\\\\', id)", "id / 7", "cast(id / 7 as decimal(12,4))", "timestamp_micros(id * 777777777)", "cast(timestamp_micros(id * 777777777) as timestamp_ntz)", "date_add(date'2020-01-01', cast(id as int))", "cast(cast(id as string) as binary)", "id % 2 = 0", "cast(id as float) / 3", "if(id % 3 = 0, double('NaN'), id / 3)", "if(id % 5 = 0, null, id)"]
    for kind in kinds:
        df = spark.range(300).selectExpr(f"{kind} AS k", "id")
        want = df.withColumn("rank", (F.row_number().over(Window.orderBy("k", "id")) - 1).cast("long"))
        assert sorted(map(str, ranks.ranked(df, [], ["k", "id"], ranges=16).collect())) == sorted(map(str, want.collect())), kind
