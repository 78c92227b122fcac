"""Header blocks of more than one stretch of inflated bytes."""

import io

from reelbase.llm import warc


def test_long_compressible_urls_keep_all_headers(spark):
    for n in (65_000, 70_000, 300_000):
        headers = {"WARC-Type": "response", "WARC-Target-URI": "u" * n, "X-Payload-Length": 4}
        both = warc.member(headers, b"same") + warc.member(headers | {"WARC-Type": "revisit", "WARC-Payload-Digest": "d"}, b"same")
        got = list(warc.records(io.BytesIO(both)))
        assert [len(h["WARC-Target-URI"]) for h, _ in got] == [n, n] and got[0][1] == b"same" and got[1][0]["WARC-Payload-Digest"] == "d"
    pages = spark.createDataFrame([(i, "http://" + "a" * 70_000, "same") for i in (1, 2)], "page_id long, url string, html string")
    assert sorted((r.record_type, r.payload_bytes) for r in warc.round_trip(pages).collect()) == [("response", 4), ("revisit", 4)]
