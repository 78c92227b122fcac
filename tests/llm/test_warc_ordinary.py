"""Archives that others wrote, split files, repeated and null ids, and the query against brute force."""

import base64
import gzip
import hashlib
import io
import random

from reelbase.llm import warc


def record(kind, uri, body, http=True, extra=b""):
    body = (b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" if http else b"") + body
    media = b"application/http; msgtype=response" if http else b"text/plain"
    head = b"WARC/1.0\r\nwarc-type:%s\r\nWARC-Target-URI:  %s\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n%sContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % (kind, uri, extra, media, len(body))
    return head + body + b"\r\n\r\n"


MADE = [record(b"warcinfo", b"", b"software: x", False), record(b"response", b"http://a/", b"one\r\n\r\ntwo"), record(b"response", b"http://b/", b"z" * 300_000, extra=b"X-Long: a\r\n  b\r\n"), record(b"revisit", b"http://c/", b"")]
WANT = [("warcinfo", b"software: x"), ("response", b"one\r\n\r\ntwo"), ("response", b"z" * 300_000), ("revisit", None)]


def test_plain_and_gzip_archives_of_others_are_read():
    for data in (b"".join(MADE), b"".join(map(gzip.compress, MADE)), gzip.compress(b"".join(MADE)), warc.member({"WARC-Type": "warcinfo"}, b"") + b"".join(map(gzip.compress, MADE))):
        got = [(h["WARC-Type"], p) for h, p in warc.records(io.BytesIO(data))]
        assert got[-4:] == WANT
        some = [(h["WARC-Target-URI"], p) for h, p in warc.records(io.BytesIO(data), lambda h: h["WARC-Type"] == "response", False)]
        assert some == [("http://a/", None), ("http://b/", None)]
    assert list(warc.records(io.BytesIO(b""))) == []
    assert warc.parsed(b"WARC/1.0\r\nX-Long: a\r\n  b\r\n") == {"X-Long": "a b"}


def test_split_files_give_each_record_once(spark, tmp_path):
    rng = random.Random(2)
    data = [record(b"response", b"http://h/%d" % i, bytes(rng.randrange(256) for _ in range(rng.randrange(4000)))) for i in range(60)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    (tmp_path / "b.warc").write_bytes(b"".join(data))
    warc.register(spark)
    df = spark.read.format("warc").option("stretchBytes", 7000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    got = sorted((r.target_uri, hashlib.sha1(r.payload).hexdigest(), r.date) for r in df.collect())
    want = sorted((f"http://h/{i}", hashlib.sha1(d.partition(b"X: y\r\n\r\n")[2][:-4]).hexdigest(), "2020-01-01T00:00:00Z") for i, d in enumerate(data) for _ in range(2))
    assert got == want


def test_query_equals_brute_force_with_repeated_and_null_ids(spark):
    rows = [(1, "u", "A"), (1, "u", "B"), (4, None, "A"), (5, "", "B"), (5, "", "B"), (None, "n", "A"), (7, "x", None), (8, "x", ""), (9, "é", "Ö"), (None, "n", "alone"), (None, "n", "alone")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    want = []
    for i, _, t in rows:
        payload = (t or "").encode()
        kept = max((j for j, _, x in rows if (x or "") == (t or "") and j is not None), default=None)
        other = kept is not None and i != kept
        want.append((str(i), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if other else "response", str(kept if other else None)))
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.round_trip(pages).collect())
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0
