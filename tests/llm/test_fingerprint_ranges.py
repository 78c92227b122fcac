"""Fingerprints against a plain sampler, and the ranges of documents: clustered ids, one id for all rows, rows without an id."""

import functools
import hashlib
import math
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from reelbase.llm import fingerprints


def h64(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed=seed)


def plain_fingerprints(texts: list[str], samples: int, log) -> list[str]:
    """The samples word by word and draw by draw. ``log`` is the engine's: a last bit of difference would change a digit."""

    @functools.cache
    def variables(word: str, k: int) -> tuple[float, float, float]:
        h = struct.pack("<Q", h64(word.encode()))
        a, b = (h64(struct.pack("<i", 2 * k + 1 + x), h64(h)) for x in (0, 1))
        part = lambda x, low: (((x >> low) & 2097151) + 0.5) / 2097152
        return -log(part(a, 0) * part(a, 21)), log(-log(part(b, 0) * part(b, 21))), part(a, 42)

    out = []
    for text in texts:
        weights = Counter(text.lower().split())
        signs = ""
        for k in range(samples if weights else 0):
            drawn = []
            for word, w in weights.items():
                r, ln_c, b = variables(word, k)
                drawn.append(ln_c - r * (math.floor(log(w) / r + b) - b + 1))
            signs += f"{h64(struct.pack('<d', min(drawn))) & 0xFFFFFFFF:08X}"
        out.append(signs)
    return out


def test_every_digit_equals_a_plain_sampler(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 600 AND text rlike '^[ -~\\n]*$'")
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, ""), (-2, "a A b a"), (-3, None)], "doc_id long, text string"))
    rows = docs.collect()
    got = {r.doc_id: r.fingerprint for r in fingerprints.edited_fingerprints(docs, samples=8).collect()}
    log = functools.cache(lambda x: spark.sparkContext._jvm.java.lang.StrictMath.log(float(x)))
    want = plain_fingerprints([r.text or "" for r in rows], 8, log)
    assert len(rows) > 15 and [got[r.doc_id] for r in rows] == want


def layouts(spark, n):
    rows = spark.range(n).withColumn("text", F.concat(F.lit("some words of "), F.md5(F.col("id").cast("string"))))
    return {
        "clustered": rows.selectExpr("if(id % 100 = 0, id * 1000000007, id) AS doc_id", "text"),
        "one id": rows.selectExpr("7L AS doc_id", "text"),
        "no id": rows.selectExpr("cast(null AS bigint) AS doc_id", "text"),
        "half without": rows.selectExpr("if(id % 2 = 0, id, null) AS doc_id", "text"),
    }


@pytest.mark.parametrize("layout", ["clustered", "one id", "no id", "half without"])
def test_ranges_are_even(spark, layout):
    rows = layouts(spark, 60_000)[layout].selectExpr("coalesce(doc_id, -1) AS doc_id", "xxhash64(text) AS h", "octet_length(text) AS bytes")
    sizes = [r["count"] for r in fingerprints.spread_slots(rows, 640)(rows).groupBy("slot").count().collect()]
    assert sum(sizes) == 60_000 and len(sizes) > 400
    assert max(sizes) < 0.02 * 60_000


@pytest.mark.parametrize("layout", ["clustered", "one id", "no id", "half without"])
def test_next_document(spark, layout, monkeypatch):
    monkeypatch.setattr(fingerprints, "COARSE", 5)
    docs = layouts(spark, 900)[layout].unionByName(spark.createDataFrame([(5, "twice"), (5, "twice"), (6, None)], "doc_id long, text string"))
    rows = docs.selectExpr("doc_id", "coalesce(text, '') AS text").withColumn("h", F.xxhash64("text")).collect()
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    want = Counter()
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after.text[:half]
        want[r.doc_id, hashlib.sha256(edited.encode()).hexdigest()] += 1
    got = fingerprints.edited_fingerprints(docs, samples=2, slot_bytes=400, partition_bytes=10_000)
    assert Counter((r.doc_id, r.edited_sha256) for r in got.collect()) == want
