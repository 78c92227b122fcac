"""The table function of bridge rows against the DataFrame operator, and each rule of contiguity broken alone."""

import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from reelbase.functions import tables
from reelbase.operators import gathers as G

CALL = "SELECT * FROM bridge_rows(TABLE({t}) PARTITION BY (k) ORDER BY (frame_index), 3)"
SCHEMA = "k string, frame_index long, vector array<double>, note string"


def test_table_function_equals_operator(spark):
    tables.register(spark)
    rows = [("a", 1, [0.0, 4.0], "x"), ("a", 9, [8.0, 0.0], "y"), ("a", 12, [8.0, 1.0], "z"), (None, 0, [1.0, 1.0], None), (None, 1, [2.0, 5.0], "n"), ("b", 3, [1.0, 1.0], "alone"), ("c", 0, None, "c"), ("c", 1, [1.0, 1.0], "c"), ("c", 2, [1.0, 3.0], "c")]
    t = spark.createDataFrame(rows, SCHEMA)
    got = spark.sql(CALL, t=t)
    assert got.columns == ["k", "note", "step", "vector"]
    ends = [(a[0], a[3], a[2], b[2]) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and a[2] and b[2]]
    want = G.bridge(spark.createDataFrame(ends, "k string, note string, x array<double>, y array<double>"), 3).select(*got.columns)
    key = lambda r: (str(r.k), str(r.note), r.step)
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == 12 and [key(r) for r in got] == [key(r) for r in want]
    assert all(r.vector == pytest.approx(w.vector) for r, w in zip(got, want, strict=True))


def test_table_function_refuses(spark):
    tables.register(spark)
    with pytest.raises(AnalysisException, match="frame_index and vector"):
        spark.sql("SELECT * FROM bridge_rows(TABLE({t}) PARTITION BY (id), 3)", t=spark.range(3))
    with pytest.raises(PythonException):
        spark.sql(CALL, t=spark.createDataFrame([("a", 0, [1.0], ""), ("a", 1, [1.0, 2.0], "")], SCHEMA)).collect()
    assert spark.sql(CALL, t=spark.createDataFrame([], SCHEMA)).count() == 0


NONE = dict(gaps=0, lengths=0, numbers=0, indexes=0, times=0)
FAULTS = {
    "none": ({}, {}, {}),
    "gap": ({"from_index": 4, "to_index": 7}, {}, {"gaps": 1, "indexes": 1}),
    "length": ({"length": 2}, {}, {"lengths": 1}),
    "number twice": ({}, {"frame_index": 0, "index": 3, "timestamp": 0.0}, {"numbers": 1}),
    "index": ({}, {"index": 9}, {"indexes": 1}),
    "time": ({}, {"timestamp": 0.05}, {"times": 1}),
    "no time": ({}, {"timestamp": None}, {}),
}


@pytest.mark.parametrize("fault", FAULTS)
def test_contiguity(spark, fault):
    of_episode, of_frame, broken = FAULTS[fault]
    episodes = [dict(repo_no=0, episode_index=e, length=3, from_index=3 * e, to_index=3 * e + 3) for e in range(2)]
    frames = [dict(repo_no=0, episode_index=e, frame_index=i, index=3 * e + i, timestamp=i / 30) for e in range(2) for i in range(3)]
    episodes[1] |= of_episode
    frames[4] |= of_frame
    got = G.contiguous(spark.createDataFrame(frames, "repo_no long, episode_index long, frame_index long, index long, timestamp double"), spark.createDataFrame(episodes, "repo_no long, episode_index long, length long, from_index long, to_index long")).first().asDict()
    assert got == {"repo_no": 0} | NONE | broken


def test_episode_without_frames(spark):
    episodes = spark.createDataFrame([(0, 0, 3, 0, 3)], "repo_no long, episode_index long, length long, from_index long, to_index long")
    frames = spark.createDataFrame([], "repo_no long, episode_index long, frame_index long, index long, timestamp double")
    got = G.contiguous(frames, episodes).select("gaps", *[F.col(c) for c in ("lengths", "numbers", "indexes", "times")]).first()
    assert tuple(got) == (0, 1, 1, 1, 1)
