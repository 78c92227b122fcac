"""The kernel against sets of strings, ridge regression against its normal equations, held-out accuracy, and odd rows."""

import math
from zlib import crc32

import numpy as np
import pytest

from reelbase.llm import language_id
from reelbase.llm.language_id import ORDERS
from reelbase.llm.queries import QUERIES

COLUMNS = ["doc_id", "held_out", "lang_pred", "score"]
TEXTS = ["The cat sat on the mat, and the dog!", "Der Hund und die Katze saßen", "le chat était là", "el niño y la niña", "x", "  42  ", "Ünïcödé ÀÉ 日本語", "the the the", "a" * 700]


def sets(text, known):
    data = language_id.prepared(text)
    for n in range(1, ORDERS + 1):
        own = {data[k : k + n] for k in range(len(data) - n + 1)}
        yield {g for g in own if b"  " not in g and int.from_bytes(b"\x01" + g, "big") in known}


def model():
    rows = [(t, lang) for lang, t in zip("ABCDABCDA", TEXTS, strict=True)]
    return language_id.fit([t for t, _ in rows], [lang for _, lang in rows], landmarks=5, piece=20)


def test_kernel_values_are_shared_n_grams():
    m = model()
    known, index = set(m.known.tolist()), language_id.Index(m.known)
    rows = [t for t in TEXTS]
    got = language_id.kernel_values([language_id.prepared(t) for t in rows], m, index)
    # landmarks in turn by language: A, B, C, D (whole texts first), then the next of A
    marks = {}
    for t in TEXTS:
        marks[t] = list(sets(t, known))
    first = {lang: next(t for t, x in zip(TEXTS, "ABCDABCDA", strict=True) if x == lang) for lang in "ABCD"}
    for j, lang in enumerate("ABCD"):
        for i, t in enumerate(rows):
            want = sum(len(x & y) / math.sqrt(max(len(x), 1) * max(len(y), 1)) for x, y in zip(marks[t], marks[first[lang]], strict=True)) / ORDERS
            assert abs(got[i, j] - want) < 1e-5


def test_index_finds_what_it_has_and_nothing_else():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(1, 1 << 44, 30_000).astype(np.uint64))
    index = language_id.Index(codes[::2])
    assert (index.of(codes[::2]) == np.arange(len(codes[::2]))).all() and (index.of(codes[1::2]) == -1).all()


def test_long_texts_in_stretches():
    m = model()
    index, text = language_id.Index(m.known), language_id.prepared(" ".join(TEXTS) * 9)
    rows = [b" x ", text, b"  ", text[:50]]
    assert (language_id.presence(rows, index, stretch=7) == language_id.presence(rows, index)).all()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op11_language_id"](spark, "/root/testdata/sf0.01").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got.values())


def test_the_model_does_not_depend_on_the_layout_or_on_held_out_rows(spark, docs):
    from pyspark.sql import functions as F

    one = language_id.train(docs)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    other = language_id.train(docs.repartition(7).withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).union(docs.limit(3)))
    assert one.languages == other.languages and (one.known == other.known).all() and np.array_equal(one.weights, other.weights)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (3, "der Hund und die Katze", "de"), (4, "der Hund ist die Katze", "de"), (5, None, "fr"), (6, "", "fr"), (7, "12 -- 4", "fr"), (None, "the dog", "en"), (9, "the mat", None)]
    rows += [(100 + k, f"the cat number {k} and the dog" if k % 2 else f"der Hund {k} und die Katze", "en" if k % 2 else "de") for k in range(40)]
    frame = spark.createDataFrame([(i, t, lang, 0.5, "y") for i, t, lang in rows], "doc_id long, text string, lang string, score double, id string")
    m = language_id.train(frame)
    assert m.languages == ["de", "en"]
    got = language_id.languages(frame, m)
    assert got.columns == COLUMNS
    out = got.collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.held_out, r.lang_pred, r.score))
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and by[1][0][1] == "en"
    assert [by[k][0][1:] for k in (5, 6, 7)] == [("und", 0.0)] * 3
    assert by[None][0][:2] == (False, "en") and by[9][0][1] == "en"


def test_nothing_learned_and_empty(spark, tmp_path):
    frame = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.languages(frame, language_id.train(frame)).collect()] == [("und", 0.0)] * 2
    frame.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op11_language_id"](spark, str(tmp_path)).count() == 0
    one = spark.createDataFrame([(1, "some text", "en"), (3, "more", "en"), (5, "x", "en"), (8, "b", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.languages(one, language_id.train(one)).collect()} == {"en"}
