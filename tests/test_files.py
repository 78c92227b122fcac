"""Listing and image sources, and the file writer."""

import struct
import zlib

import pytest

from reelbase.registry import QUERIES
from reelbase.sources import files


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + bytes(3000)


def jpeg(w, h, before=(b"\xe0" + bytes(14), b"\xe1" + bytes(40_000), b"\xc4" + bytes(60)), frame=0xC0):
    segments = b"".join(b"\xff" + s[:1] + struct.pack(">H", len(s) + 1) + s[1:] for s in before)
    return b"\xff\xd8" + segments + b"\xff\xff" + bytes([frame]) + struct.pack(">HBHH", 17, 8, h, w) + bytes(5000)


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h) + bytes(900)


def webp(kind, body):
    return b"RIFF" + bytes(4) + b"WEBP" + kind + bytes(4) + body + bytes(200)


IMAGES = {
    "a/one.png": (png(640, 480), ("png", 640, 480)),
    "a/two.JPG": (jpeg(33, 70_00), ("jpeg", 33, 7000)),
    "a/b/c/three.jpeg": (jpeg(5, 6, frame=0xC2), ("jpeg", 5, 6)),
    "four.gif": (gif(9, 300), ("gif", 9, 300)),
    "a/b/five.bmp": (b"BM" + bytes(12) + struct.pack("<Iii", 40, 12, -34) + bytes(99), ("bmp", 12, 34)),
    "w/lossy.webp": (webp(b"VP8 ", bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 400, 301)), ("webp", 400, 301)),
    "w/lossless.webp": (webp(b"VP8L", b"\x2f" + struct.pack("<I", (39) | (59 << 14))), ("webp", 40, 60)),
    "w/more.webp": (webp(b"VP8X", bytes(4) + (1023).to_bytes(3, "little") + (767).to_bytes(3, "little")), ("webp", 1024, 768)),
    "bad/empty.png": (b"", None),
    "bad/cut.png": (png(3, 4)[:20], None),
    "bad/no.jpg": (b"no image at all", None),
    "bad/scan.jpg": (b"\xff\xd8\xff\xda" + bytes(500), None),
    "bad/cut.jpg": (jpeg(1, 2)[:40_080], None),
    "bad/zero.gif": (gif(0, 5), None),
    "bad/far.jpg": (jpeg(8, 9, before=(b"\xe1" + bytes(60_000),) * 9), ("jpeg", 8, 9)),
    "a/text.txt": (png(1, 1), None),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("files"))
    rows = spark.createDataFrame([(k, bytearray(v)) for k, (v, _) in IMAGES.items()], "path string, content binary")
    assert files.write_files(rows.repartition(3), root) == len(IMAGES)
    return root


def test_files_are_written_whole_and_again(spark, folder):
    for path, (content, _) in IMAGES.items():
        with open(f"{folder}/{path}", "rb") as f:
            assert f.read() == content
    rows = spark.createDataFrame([("a/one.png", bytearray(png(640, 480))), (None, bytearray(b"x")), ("x/empty", None)], "path string, content binary")
    assert files.write_files(rows, f"{folder}-again") == 2 and files.write_files(rows, f"file://{folder}-again") == 2
    assert sorted(r.path for r in files.listing(spark, f"{folder}-again").where("not is_dir").collect()) == ["a/one.png", "x/empty"]
    for path in ("../x", "/x", "a//b", "", "a/./b"):
        with pytest.raises(Exception, match="below the root"):
            files.write_files(spark.createDataFrame([(path, bytearray(b"x"))], "path string, content binary"), f"{folder}-out")


@pytest.mark.parametrize("options", [{}, {"depth": 0}, {"depth": 3}, {"shares": 4}, {"tasks": 2, "depth": 2}])
def test_listing_has_every_file_and_folder_once(spark, folder, options):
    got = files.listing(spark, f"file://{folder}", **options).collect()
    assert sorted((r.path, r.bytes) for r in got if not r.is_dir) == sorted((k, len(v)) for k, (v, _) in IMAGES.items())
    assert sorted(r.path for r in got if r.is_dir) == ["a", "a/b", "a/b/c", "bad", "w"]
    assert all(r.path == (f"{r.dir}/{r.name}" if r.dir else r.name) and r.modified for r in got)


def test_listing_is_planned_by_folder_and_a_missing_one_is_empty(spark, folder):
    assert files.listing(spark, folder).rdd.getNumPartitions() == 4  # the root's own files, a, bad, w
    assert files.listing(spark, folder, shares=5).rdd.getNumPartitions() == 20
    assert files.listing(spark, f"{folder}/nothing").count() == 0
    assert sorted(r.path for r in files.listing(spark, folder, depth=0, recursive=False).collect()) == ["a", "bad", "four.gif", "w"]
    with pytest.raises(Exception, match="path is missing"):
        spark.read.format("reel_files").load().collect()


def test_image_headers(spark, folder):
    got = {r.path: r for r in files.image_headers(spark, folder, shares=2).collect()}
    want = {k: x for k, (_, x) in IMAGES.items() if x and not k.endswith("txt")}
    assert {k: (r.format, r.width, r.height) for k, r in got.items()} == want
    assert all(r.bytes == len(IMAGES[k][0]) for k, r in got.items())


def test_image_headers_read_few_bytes(spark, folder):
    rows = files.image_headers(spark, folder, unreadable="keep").collect()
    assert len(rows) == len(IMAGES) - 1 and sum(r.width is None for r in rows) == 6
    assert all(r.header_bytes <= 150 for r in rows)
    short = {r.path: (r.width, r.header_bytes) for r in files.image_headers(spark, folder, unreadable="keep", most=40).collect()}
    assert short["a/one.png"] == (640, 30) and short["bad/far.jpg"][0] is None and all(n <= 40 for _, n in short.values())


def test_checkpoints_need_a_number_and_a_payload(spark, tmp_path):
    names = ["500/pretrained_model/config.json", "500/pretrained_model/weights", "000750/pretrained_model/w", "1000/optimizer", "last/pretrained_model/w", "12a/pretrained_model/w", "1500/pretrained_models/w", "2000/pretrained_model", "x/2500/pretrained_model/w"]
    files.write_files(spark.createDataFrame([(n, bytearray(b"1")) for n in names], "path string, content binary"), str(tmp_path))
    assert sorted(map(tuple, files.checkpoints(spark, str(tmp_path)).collect())) == [(500, "500/pretrained_model"), (750, "000750/pretrained_model"), (2000, "2000/pretrained_model")]
    assert [r.step for r in files.checkpoints(spark, str(tmp_path), wanted=[2000, 500, 500]).orderBy("step").collect()] == [500, 2000]
    with pytest.raises(Exception, match="no checkpoint of step 1000"):
        files.checkpoints(spark, str(tmp_path), wanted=[500, 1000]).collect()


def test_crc_shares_use_the_path(spark, folder):
    parts = files.FolderReader(None, {"path": folder, "shares": "3"}).partitions()
    seen = [f.path for p in parts for _, _, f in files.FolderReader(None, {"path": folder}).entries(p)]
    assert len(seen) == len(set(seen)) and all(zlib.crc32(f.encode()) >= 0 for f in seen)


@pytest.mark.parametrize("name", ["src_06_rectangular_pool", "src_07_preferred_photos", "src_10_checkpoints", "src_11_image_headers", "src_12_inventory"])
def test_files_are_written_by_as_many_tasks_as_their_number_asks_for(spark, monkeypatch, name):
    plain, tasks = files.write_files, []

    def counted(rows, root):
        tasks.append(rows.rdd.getNumPartitions())
        return plain(rows, root)

    monkeypatch.setattr(files, "FILES", 7, raising=False)
    monkeypatch.setattr(files, "write_files", counted)
    QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert tasks[0] >= 8
