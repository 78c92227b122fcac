"""Playback over a stream and over a batch: late, repeated and interrupted ticks, the cut, and the timer."""

import time

import pandas as pd
import pytest

from reelbase.streaming import playback
from reelbase.streaming.playback import Player, Playing, Rollout

SCHEMA = "rollout long, step long, value double, t_ms long"
#: Three arrivals: steps out of order, a gap, repeats with other values, late ones, and rollout 2 running over its limit.
ARRIVALS = [
    [(1, 2, 12.0, 200), (1, 0, 10.0, 0), (1, 1, 11.0, 100), (1, 1, 99.0, 150), (2, 0, 5.0, 1000), (3, None, 1.0, 0), (None, 1, 1.0, 0)],
    [(1, 1, 50.0, 250), (1, 7, 17.0, 700), (1, 8, 18.0, 800), (2, 1, 6.0, 1900), (2, 3, 8.0, 2000), (2, 2, 7.0, 1950)],
    [(1, 9, 19.0, 900), (2, 4, 9.0, 1100), (4, 5, 1.5, 0), (1, 8, 0.0, 901)],
]
PLAYER = Player(size=3, limit_ms=1000)
WANT = [
    (1, 0, 10.0, 10.0, True),
    (1, 1, 10.5, 10.0, False),
    (1, 2, 11.0, 10.0, False),
    (1, 7, 17.0, 10.0, True),
    (1, 8, 17.5, 10.0, False),
    (1, 9, 18.0, 10.0, False),
    (2, 0, 5.0, 5.0, True),
    (2, 1, 5.5, 5.0, False),
    (2, 2, 6.0, 5.0, False),
    (4, 5, 1.5, 1.5, True),
]


def test_batch(spark):
    rows = [(*t, k) for k, ticks in enumerate(ARRIVALS) for t in ticks]
    ticks = spark.createDataFrame(rows, f"{SCHEMA}, arrival long")
    got = playback.played(ticks.repartition(3), PLAYER)
    assert sorted(tuple(r)[:5] for r in got.collect()) == WANT
    key, most = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "2")
    try:
        assert sorted(tuple(r)[:5] for r in got.collect()) == WANT
    finally:
        spark.conf.set(key, most)
    assert playback.played(ticks.limit(0), PLAYER).count() == 0


def stop_after(q, rows):
    """With processing-time timers a query never runs out of batches by itself: it is stopped once a finished batch has read the rows."""
    end = time.time() + 90
    try:
        while sum(p.numInputRows for p in q.recentProgress) < rows:
            assert time.time() < end and q.exception() is None
            time.sleep(0.2)
    finally:
        q.stop()


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for ticks in ARRIVALS:  # each arrival is a restart of the query
            spark.createDataFrame(ticks, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = playback.playing(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), PLAYER)
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
            stop_after(q, len(ticks))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    answered = sorted(tuple(r)[:5] for r in rows if not r.closed)
    # by the wall clock a timer may close a rollout between two restarts; what was answered before is the same
    shut = {r.rollout for r in rows if r.closed}
    assert [a for a in answered if a[0] not in shut] == [w for w in WANT if w[0] not in shut]
    assert all(a in WANT for a in answered) and {a[0] for a in answered} == {1, 2, 4}


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema, ttlDurationMs=None):
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


class Now:
    def getCurrentProcessingTimeInMs(self):
        return 50_000


def test_timer_closes_once_and_late_ticks_stay_out():
    p, handle = Playing(PLAYER, 1), Handle()
    p.init(handle)
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["rollout", "step", "value", "t_ms"])])
    first = list(p.handleInputRows((1,), frame((1, 0, 4.0, 0), (1, 1, 5.0, 10)), Now()))
    assert first[0]["sent"].tolist() == [4.0, 4.5] and handle.timers == [51_000]
    list(p.handleInputRows((1,), frame((1, 2, 5.0, 20)), Now()))
    assert handle.timers == [51_000]
    shut = list(p.handleExpiredTimer((1,), Now(), None))
    assert shut[0]["closed"].tolist() == [True] and shut[0]["latched"].tolist() == [4.0] and shut[0]["step"].isna().all()
    assert list(p.handleExpiredTimer((1,), Now(), None)) == [] and list(p.handleInputRows((1,), frame((1, 3, 6.0, 30)), Now())) == []


@pytest.mark.parametrize("size", [1, 4])
def test_interrupted_in_any_place(size):
    ticks = [(k, float(k * k), 100 * k) for k in range(40)]
    whole = list(Player(size, 2500).answers(Rollout.new(), iter(ticks)))
    assert len(whole) == 25
    for cut in range(0, 40, 3):
        state = Rollout.new()
        p = Player(size, 2500)
        assert [*p.answers(state, iter(ticks[:cut])), *p.answers(state, iter(ticks[cut:]))] == whole
