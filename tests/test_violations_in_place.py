"""The rules of a synthetic corpus, found where its rows are made: equal to those found by joins of tables, for every kind of fault, and no row is written or shuffled."""

import pytest
from pyspark.sql import functions as F

from reelbase.operators.gathers import CELL
from reelbase.plans import correctness
from reelbase.registry import QUERIES

N = 3


def sides(spark):
    side = lambda eps: spark.createDataFrame([(s, e, i, [float(e * 7 % 5), float(i * i % 11)]) for s, e, n in eps for i in range(n)], "slot long, ep long, frame long, x array<double>")
    return side([(0, 3, 2), (0, 5, 7), (0, 6, 1), (1, 4, 5), (2, 9, 1)]), side([(0, 7, 3), (0, 9, 1), (1, 8, 6), (1, 6, 2), (2, 1, 9)])


def changed(rows, **to):
    """Columns set to a value where a condition holds; both are SQL."""
    return rows.withColumns({c: F.expr(f"CASE WHEN {where} THEN {value} ELSE {c} END") for c, (where, value) in to.items()})


def in_rows(rows, episodes):
    rows = changed(rows, action_0=("(frame_index + episode_index) % 5 = 3", "action_0 - 2"), action_1=("slot = 1 AND frame_index = 6", "NULL"), task=("slot = 0 AND episode_index % 2 = 0 AND frame_index = 1", "NULL"), task_index=("slot = 2 AND frame_index = 3", "1"))
    return changed(rows, action_1=("slot = 2 AND frame_index = 5", "double('NaN')")).where("NOT (slot = 0 AND episode_index = 2 AND frame_index IN (1, 4))"), episodes


def in_order(rows, episodes):
    rows = changed(rows, index=("slot = 0 AND episode_index = 1 AND frame_index = 2", "index + 1"), frame_index=("slot = 1 AND episode_index = 0 AND frame_index < 2", "1 - frame_index"))
    return changed(rows, index=("slot = 2 AND frame_index = 4", "NULL")), episodes


def in_tables(rows, episodes):
    episodes = changed(episodes, from_index=("slot = 0 AND episode_index = 3", "from_index + 1"), length=("slot = 1 AND episode_index = 1", "length - 1"))
    twice = episodes.where("slot = 0 AND episode_index IN (0, 4)")
    return rows, episodes.where("NOT (slot = 2)").unionByName(twice).unionByName(changed(twice, episode_index=("true", "episode_index + 70")))


FAULTS = {"none": (lambda r, e: (r, e), 2), "rows": (in_rows, 2), "order": (in_order, 256), "tables": (in_tables, 2)}


@pytest.mark.parametrize("fault", sorted(FAULTS))
def test_as_by_joins(spark, monkeypatch, fault):
    change, chunk = FAULTS[fault]
    monkeypatch.setattr(correctness, "CHUNK", chunk)
    a, p = sides(spark)
    packs, episodes = correctness.packed_corpus(a, p, N, 2, 2)
    info = episodes.groupBy("slot").agg(F.sum("length").alias("total_frames"), F.count(F.lit(1)).alias("total_episodes")).withColumn("expected_frames", F.expr("total_frames + slot"))
    rows, listed = change(correctness.unpacked(packs, 2).withColumns({"task_index": F.lit(0), "task": F.lit("t")}), episodes)
    plan = packs.where("a_c = 0 AND p_c = 0").select("slot", "episode_index", *CELL)
    got = correctness.violations_in_place(rows, listed, plan, info, N, "t", 2)
    general = rows.select("slot", "episode_index", "frame_index", "index", "task_index", "task", F.array("action_0", "action_1").alias("action"))
    want = correctness.violations(general, listed.drop(*CELL), info, a, p, N, "t", 2)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    broken = {r.rule for r in got.where("violations > 0").collect()}
    assert broken >= {"none": {"S8"}, "rows": {"S1", "S5", "S6", "S7", "P1", "P2", "P3", "P4"}, "order": {"S4", "S5"}, "tables": {"S2", "S3", "C1"}}[fault]


def test_no_row_is_written_or_shuffled(spark, monkeypatch):
    """The corpus used to be written whole and shuffled four times."""
    written, old = {}, correctness.written_once

    def kept(df, tag):
        written[tag] = df
        return old(df, tag)

    monkeypatch.setattr(correctness, "written_once", kept)
    QUERIES["dq_12_synthetic_correctness"](spark, "/root/testdata/sf0.001")
    assert "checked-corpus" not in written and "planned" not in written
    plan = written["counted-slots"]._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("episode_index" in line for line in dealt)
