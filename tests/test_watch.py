"""The checkpoint watch: once each, in order, over restarts and errors, and what ends it."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from reelbase.streaming import watch


@pytest.fixture()
def place(spark, tmp_path):
    def drop(*steps, rows=2):
        data = [(s, s / 1000 + k) for s in steps for k in range(rows)]
        spark.createDataFrame(data, watch.CHECKPOINT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def judge(rows):
        bad = F.raise_error(F.lit("no such payload")).cast("double")
        return rows.groupBy("step").agg(F.avg(F.when(F.col("step") % 7 == 0, bad).otherwise(F.col("loss"))).alias("score"))

    made = watch.Watch(spark, str(tmp_path / "in"), str(tmp_path / "metrics"), str(tmp_path / "state"), judge)
    return drop, made


def known(spark, w):
    return [(r.batch, r.step, r.error is not None) for r in w.records().orderBy("batch", "step").collect()]


def test_each_step_once_over_restarts(spark, place):
    drop, w = place
    drop(100, 200)
    assert not watch.finished(spark, w.metrics, 200) and w.run() == "drained"
    assert known(spark, w) == [(0, 100, False), (0, 200, False)] and watch.finished(spark, w.metrics, 200) and not watch.finished(spark, w.metrics, 201)
    assert w.run() == "drained" and len(known(spark, w)) == 2
    drop(300, 100)  # 100 comes again
    assert w.run() == "drained" and known(spark, w)[2:] == [(1, 300, False)]


def test_errors_while_computing_are_recorded_and_the_watch_goes_on(spark, place):
    drop, w = place
    drop(50, 70, 140, 90)
    assert w.run(final_step=140) == "drained"  # the final step itself failed
    assert known(spark, w) == [(0, 50, False), (0, 70, True), (0, 90, False), (0, 140, True)]
    assert "no such payload" in w.records().where("step = 70").first().error and not watch.finished(spark, w.metrics, 100)
    drop(150)
    assert w.run(final_step=140) == "final" and known(spark, w)[-1] == (1, 150, False)


def test_steps_after_the_final_one_are_left(spark, place):
    drop, w = place
    drop(30, 10, 20, 40)
    assert w.run(final_step=15) == "final" and known(spark, w) == [(0, 10, False), (0, 20, False)]


def test_once_ends_after_the_first_that_can_be_judged(spark, place):
    drop, w = place
    drop(7, 14, 20, 30)
    assert w.run(once=True) == "once" and known(spark, w) == [(0, 7, True), (0, 14, True), (0, 20, False)]


def test_idle_waits_for_late_files_and_then_ends(spark, place):
    drop, w = place
    drop(10)
    late = threading.Thread(target=lambda: (time.sleep(3), drop(20)))
    late.start()
    begun = time.time()
    assert w.run(idle_s=8.0) == "idle"
    late.join()
    assert [s for _, s, _ in known(spark, w)] == [10, 20] and time.time() - begun > 8


def test_an_error_of_the_stream_is_raised(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        watch.watch_checkpoints(spark, str(tmp_path / "nothing"), str(tmp_path / "m"), str(tmp_path / "s"), lambda rows: rows)
