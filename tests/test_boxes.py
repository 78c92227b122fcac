"""Merging of boxes against a plain loop, in every order."""

import itertools
import random

from pyspark.sql import functions as F

from reelbase.functions import text as X

BOX = "array<struct<x0: double, y0: double, x1: double, y1: double>>"


def plain(boxes):
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    kept = []
    for b in boxes:
        for i, k in enumerate(kept):
            w, h = min(b[2], k[2]) - max(b[0], k[0]), min(b[3], k[3]) - max(b[1], k[1])
            if w > 0 and h > 0 and w * h / min(area(b), area(k)) > 0.5:
                if area(b) > area(k):
                    kept[i] = b
                break
        else:
            kept.append(b)
    return kept


def test_merged_boxes_in_every_order(spark):
    three = [(0.0, 0.0, 10.0, 10.0), (12.0, 0.0, 22.0, 10.0), (0.0, 0.0, 22.0, 10.0)]
    assert len(plain(three)) == 2
    rng = random.Random(3)
    lists = [list(p) for p in itertools.permutations([*three, (1.0, 1.0, 9.0, 9.0)])]
    for _ in range(300):
        lists.append([(x, y, x + rng.randint(1, 20), y + rng.randint(1, 20)) for x, y in ((rng.randint(0, 20) * 1.0, rng.randint(0, 20) * 1.0) for _ in range(rng.randint(0, 9)))])
    lists += [[], [(1.0, 1.0, 1.0, 5.0), (1.0, 1.0, 1.0, 5.0)]]
    lists = [[tuple(map(float, b)) for b in x] for x in lists]
    got = spark.createDataFrame(list(enumerate(lists)), f"i long, b {BOX}").select("i", X.merged_boxes(F.col("b")).alias("m")).withColumn("l", X.largest_box(F.col("m"))).collect()
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    for r in got:
        want = plain(lists[r.i])
        assert [tuple(b) for b in r.m] == want
        assert (tuple(r.l) if r.l else None) == (max(want, key=area) if want else None)
