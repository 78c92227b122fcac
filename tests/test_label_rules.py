"""Each rule of the full label audit fails alone for a dataset made to break it; every case is a collection of its own."""

import pytest

from reelbase.plans import label_rules

NAME = "dataset_v2_person_a_{}_1"
WHO = {"person_a": "Person A", "person_b": "Person B"}
WHERE = {p: f"<{p} marker>" for p in ("left", "middle", "right")}
SWING = {"left": 60.0, "middle": 0.0, "right": -60.0}
FRAMES = "collection string, repo_id string, episode_index long, frame_index long, pan double, lift double, elbow double, wrist_flex double, wrist_roll double, gripper double"
TASKS = "collection string, repo_id string, task string"
INFO = "collection string, repo_id string, codebase_version string, fps int, total_frames long"


def episodes(case, name, peak, start=0.0, wrist=40.0, gripper=10.0, end=(0.0, 0.0), dip=None, bad=None, count=3, n=12):
    pan = [start] * 3 + [peak] * (n - 6) + [end[i % 2] for i in range(3)]
    if dip is not None:
        pan[5] = dip
    return [(case, name, e, i, x, 0.0, 0.0, wrist if i >= n - 3 else 0.0, 0.0, bad if bad is not None and i == 4 else gripper) for e in range(count) for i, x in enumerate(pan)]


LEFT, MIDDLE, RIGHT = (NAME.format(p) for p in SWING)
#: case: the dataset, its texts, frames that its info counts too many, metrics that fail, overall verdict
CASES = {
    "clean": (dict(name=LEFT, peak=60.0), ["for PERSON a"], 0, set(), "PASS"),
    "half way": (dict(name=LEFT, peak=32.0), ["person a"], 0, {"m2"}, "WARN"),
    "no swing": (dict(name=RIGHT, peak=-60.0, start=-58.0), ["person a"], 0, {"m3"}, "WARN"),
    "wrong side": (dict(name=LEFT, peak=70.0, dip=-61.0), ["person a"], 0, {"m4"}, "WARN"),
    "closed": (dict(name=MIDDLE, peak=1.0, gripper=4.9), ["person a"], 0, {"m5"}, "WARN"),
    "wrist rests": (dict(name=MIDDLE, peak=1.0, wrist=5.0), ["person a"], 0, {"m6"}, "WARN"),
    "restless": (dict(name=LEFT, peak=60.0, end=(-12.0, 12.0)), ["person a"], 0, {"m7"}, "WARN"),
    "other place": (dict(name=LEFT, peak=-60.0), ["person a"], 0, {"m1", "m2", "m3", "m4"}, "FAIL"),
    "two persons": (dict(name=LEFT, peak=60.0), ["person a, not Person B"], 0, {"m9"}, "FAIL"),
    "nobody": (dict(name=LEFT, peak=60.0), ["place it"], 0, {"m8"}, "FAIL"),
    "two texts": (dict(name=LEFT, peak=60.0), ["person a", "for person a"], 0, {"m10"}, "FAIL"),
    "no texts": (dict(name=LEFT, peak=60.0), [], 0, {"m10"}, "FAIL"),
    "no such form": (dict(name="my_" + LEFT, peak=60.0), ["person a"], 0, {"m11"}, "FAIL"),
    "miscounted": (dict(name=LEFT, peak=60.0), ["person a"], 1, {"m12"}, "FAIL"),
    "board": (dict(name="dataset_v3_charuco_right_1", peak=-60.0), ["to the <RIGHT marker>"], 0, set(), "PASS"),
    "board, other marker": (dict(name="dataset_v3_charuco_right_1", peak=-60.0), ["<right marker>, <left marker>"], 0, {"m9"}, "FAIL"),
    "no position": (dict(name="person_a_1", peak=17.0), ["person a"], 0, set(), "PASS"),
    "missing value": (dict(name="person_a_1", peak=17.0, bad=float("nan")), ["person a"], 0, {"m5", "m6", "m7", "m12"}, "FAIL"),
}


@pytest.fixture(scope="module")
def audited(spark):
    frames, tasks, info = [], [], []
    for case, (given, texts, more, _, _) in CASES.items():
        own = episodes(case, **given)
        base = {f"dataset_v2_person_b_{p}_1": episodes(case, f"dataset_v2_person_b_{p}_1", x, count=5) for p, x in SWING.items()}
        frames += own + [r for rows in base.values() for r in rows]
        tasks += [(case, given["name"], t) for t in texts] + [(case, b, "for person B") for b in base]
        info += [(case, given["name"], "v3.0", 30, len(own) + more)] + [(case, b, "v3.0", 30, len(rows)) for b, rows in base.items()]
    long = label_rules.metrics(spark.createDataFrame(frames, FRAMES), spark.createDataFrame(tasks, TASKS), spark.createDataFrame(info, INFO), WHO, WHERE, 3, 3)
    return {(r.collection, r.repo_id): r for r in label_rules.verdicts(long).collect()}


@pytest.mark.parametrize("case", CASES)
def test_rule(audited, case):
    given, _, _, broken, overall = CASES[case]
    got = audited[case, given["name"]]
    assert {f"m{i}" for i in range(1, 13) if got[f"m{i}"] is False} == broken
    assert got["overall"] == overall
    placeless = given["name"].startswith(("my_", "person_a_1"))
    assert all((got[f"m{i}"] is None) == placeless for i in range(1, 5))


def test_the_other_datasets_pass(audited):
    assert {r.overall for (c, n), r in audited.items() if n != CASES[c][0]["name"]} == {"PASS"}


def test_positions_too_close_give_advice(spark):
    rows = [r for p, x in (("left", 4.0), ("middle", 0.0), ("right", -4.0)) for r in episodes("c", NAME.format(p), x)] + episodes("c", "person_a_1", 0.0)
    none = spark.createDataFrame([], TASKS), spark.createDataFrame([], INFO)
    got = label_rules.verdicts(label_rules.metrics(spark.createDataFrame(rows, FRAMES), *none, WHO, WHERE, 3, 3)).collect()
    assert {r.repo_id: r.overall for r in got} == {NAME.format(p): "ADVISORY" for p in SWING} | {"person_a_1": "FAIL"}


def test_no_datasets(spark):
    none = [spark.createDataFrame([], x) for x in (FRAMES, TASKS, INFO)]
    assert label_rules.verdicts(label_rules.metrics(*none, WHO, WHERE)).count() == 0
