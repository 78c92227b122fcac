"""Pool files of differing shapes, photo ranks and the checks on them."""

import json

import pytest

from reelbase.registry import QUERIES
from reelbase.sources import files, pools


@pytest.fixture(scope="module")
def pool(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("pool"))
    names = ["a/one/2.jpg", "a/one/10.jpg", "a/one/note.txt", "b/one/1.jpg", "a/two/1.jpg", "c/three/9.jpg", "c/three/8.jpg"]
    one = {"made": "x", "celebrities": [{"slug": "two", "name": "Two", "dir": "a/two", "more": {"deep": [1]}}, {"slug": "one", "dir": "a/one"}]}
    two = {"celebrities": [{"slug": "three", "dir": "c/three", "quality_photos": ["q/5.png", "q/1.jpg"], "rank": 3}, {"slug": "none", "dir": "c/none"}, {"slug": "one", "dir": "b/one", "quality_photos": []}], "other": None}
    rows = [(n, bytearray(b"x")) for n in names] + [("p/1.json", bytearray(json.dumps(one, indent=2).encode())), ("p/2.json", bytearray(json.dumps(two, indent=1).encode()))]
    files.write_files(spark.createDataFrame(rows, "path string, content binary"), root)
    return root


def test_entries_and_photos(spark, pool):
    p = pools.scan_pools(spark, [f"{pool}/p/1.json", f"{pool}/p/2.json"])
    assert [(r.file, r.entry, r.slug, r.name) for r in p.orderBy("file", "entry").collect()] == [(0, 0, "two", "Two"), (0, 1, "one", None), (1, 0, "three", None), (1, 1, "none", None), (1, 2, "one", None)]
    listing = files.listing(spark, pool)
    got = lambda **kw: sorted((r.slug, r.rank, r.path) for r in pools.photos(p, listing, **kw).collect())
    one = [("one", 0, "a/one/10.jpg"), ("one", 1, "a/one/2.jpg"), ("one", 2, "b/one/1.jpg")]
    assert got() == [*one, ("three", 0, "q/5.png"), ("three", 1, "q/1.jpg"), ("two", 0, "a/two/1.jpg")]
    assert got(prefer_quality=False) == [*one, ("three", 0, "c/three/8.jpg"), ("three", 1, "c/three/9.jpg"), ("two", 0, "a/two/1.jpg")]


def test_rectangular_and_usable(spark, pool):
    found = pools.photos(pools.scan_pools(spark, [f"{pool}/p/1.json", f"{pool}/p/2.json"]), files.listing(spark, pool))
    assert sorted((r.slug, r.path) for r in pools.rectangular(found, ["three", "one"]).collect()) == [("one", "a/one/10.jpg"), ("one", "a/one/2.jpg"), ("three", "q/1.jpg"), ("three", "q/5.png")]
    with pytest.raises(Exception, match="no photos found for none"):
        pools.rectangular(found, ["one", "none"]).collect()
    assert pools.usable(found, 3).count() == found.count()
    with pytest.raises(Exception, match="too few usable identities: 3"):
        pools.usable(found, 4).collect()
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        files.write_files(spark.createDataFrame([("p/bad.json", bytearray(b"{ no"))], "path string, content binary"), pool)
        pools.scan_pools(spark, [f"{pool}/p/bad.json"]).collect()


def test_folders_are_listed_once_and_ranks_computed_once(spark, pool):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    listing = files.listing(spark, pool)
    assert "reel_files" in plan(listing)
    found = pools.photos(pools.scan_pools(spark, [f"{pool}/p/1.json", f"{pool}/p/2.json"]), listing)
    assert "reel_files" not in plan(found)
    assert "Window" not in plan(pools.rectangular(found, ["three", "one"])) and "Window" not in plan(pools.usable(found, 3))


def test_folders_of_both_sides_are_listed_by_a_task_each(spark, monkeypatch):
    plain, tasks = files.listing, []

    def counted(*args, **options):
        tasks.append((found := plain(*args, **options)).rdd.getNumPartitions())
        return found

    monkeypatch.setattr(files, "listing", counted)
    got = QUERIES["src_06_rectangular_pool"](spark, "/root/testdata/sf0.01").count()
    assert got > 0 and tasks[0] > 50  # 25 brands on each side, and the folders above them
