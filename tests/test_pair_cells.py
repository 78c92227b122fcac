"""Corpus rows made and checked in the cells in which the pairs meet: equal to the check by joins, whatever the packs and cells, and without a shuffle of a row."""

import pytest
from pyspark.sql import functions as F

from reelbase.operators import gathers as G
from reelbase.plans import correctness
from reelbase.registry import QUERIES

N = 3


def sides(spark):
    side = lambda eps: spark.createDataFrame([(s, e, i, [float(e * 7 % 5), float(i * i % 11)]) for s, e, n in eps for i in range(n)], "slot long, ep long, frame long, x array<double>")
    return side([(0, 3, 2), (0, 5, 7), (0, 6, 1), (1, 4, 5), (2, 9, 1)]), side([(0, 7, 3), (0, 9, 1), (1, 8, 6), (1, 6, 2), (2, 1, 9)])


def damaged(rows):
    """A shifted row of each segment, an infinite, a missing and a displaced one."""
    at, k = F.col("frame_index"), F.col("episode_index")
    rows = rows.where(~((k == 1) & (at == 2)))
    rows = rows.withColumn("action_0", F.when(at % 4 == k % 3, F.col("action_0") + 0.5).when((k == 0) & (at == 1), float("inf")).otherwise(F.col("action_0")))
    rows = rows.withColumn("action_1", F.when((F.col("slot") == 1) & (at == 6), None).otherwise(F.col("action_1")))
    return rows.withColumn("frame_index", F.when((F.col("slot") == 2) & (at == 0), 99).otherwise(at))


@pytest.mark.parametrize("chunk", [2, 256])
@pytest.mark.parametrize("side", [1, 128])
def test_found_in_place_as_by_joins(spark, monkeypatch, chunk, side):
    monkeypatch.setattr(correctness, "CHUNK", chunk)
    a, p = sides(spark)
    packs, _ = correctness.packed_corpus(a, p, N, 2, side)
    rows = damaged(correctness.unpacked(packs, 2))
    own = ["slot", "episode_index", "frame_index", "index"]
    got = correctness.found_in_place(rows, N, 2).select(*own, "seg", "difference").collect()
    corpus = rows.select(*own, F.array("action_0", "action_1").alias("action"))
    want = correctness.sources_of(corpus, correctness.provenance(a, p), a, p, N, 4).select(*own, "seg", "difference").collect()
    key = lambda r: (*r[:4], -1 if r.seg is None else r.seg, round(r.difference, 9))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len({r.seg for r in got}) == 4 and sum(r.difference > 1e-9 for r in got) > 10


def test_no_row_is_shuffled(spark):
    """Every row used to be shuffled to its plan and then to its source: at 60 times sf0.1 some 1.7 TB."""
    plan = QUERIES["jn_15_source_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 3 and sum("seg#" in line for line in dealt) == 1 and not any("episode_index" in line or "_ep#" in line for line in dealt)


def test_rows_are_sent_to_few_cells(spark):
    """The blocks grow with the table: what is shuffled follows the sides, no longer the pairs."""
    side = lambda lo: spark.range(lo, lo + 600).select(F.lit(0).alias("slot"), F.col("id").alias(f"k{lo}"))
    met = G.cells(side(0), side(1000), ["slot"], side=4)
    assert met.count() == 360_000 and met.select("k0", "k1000").distinct().count() == 360_000
    assert met.select("k0", "_j").distinct().count() <= 600 * 17 and met.select("_i", "_j").distinct().count() > 200
