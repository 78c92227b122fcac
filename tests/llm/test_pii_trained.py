"""The trained path: base spans against a plain version, tree SQL against a loop, recall and precision of added spans on planted texts, long texts."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelbase.llm import pii

DATA = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DATA)


@pytest.fixture(scope="module")
def model(docs):
    return pii.train(docs, planted_rows=1500)


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    t, out = text or "", []
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
    )
    for kind, pattern, check in rules:
        found = [(m.start(), m.end()) for m in re.finditer(pattern, t) if check(m[0], re.sub("[^0-9]", "", m[0]))]
        out.append((kind, found))
    return out


def test_base_columns_equal_a_plain_version(docs, model):
    odd = docs.sparkSession.createDataFrame([(-1, None), (-2, ""), (-3, "x@y.z " * 300 + "1.2.3.4 " * 200 + "é +1 234 567 8901 " * 150)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    got = {r.doc_id: r for r in pii.digest(both, model).collect()}
    for r in both.collect():
        base = brute(r.text)
        own = got[r.doc_id]
        assert [own.n_email, own.n_ip, own.n_card, own.n_phone] == [len(x) for _, x in base]
        joined = ",".join(f"{k}:{a}:{b}" for k, x in base for a, b in x)
        assert own.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(own.spans.split(","))


def test_added_spans_are_found_and_right(spark, docs, model):
    carriers = [r[0] for r in docs.selectExpr("substring(text, 100, 50)").collect()]
    made = spark.createDataFrame(pii.planted_texts(carriers, 1000, 99), "t string, own string, from_ int, to_ int")
    got, base = pii.measured(model, made), pii.measured(None, made)
    for kind, least in (("phone", 0.8), ("email", 0.7), ("card", 0.6), ("ip", 0.8)):
        assert got[kind][0] >= least and got[kind][0] > base[kind][0] and got[kind][1] >= min(0.85, base[kind][1])
    shown = pii.redacted(spark.createDataFrame([(0, "please call (212) 555-0143 today", 1)], "doc_id long, text string, _m int"), model).first()
    assert shown.text == "please call [phone] today" and shown._m == 1


def test_tree_sql_equals_the_trees(spark, model):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 16, (200, len(pii.FEATURES))).astype(float)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    named = F.struct(*[F.col("v")[j].alias(n) for j, n in enumerate(pii.FEATURES)]).alias("x")
    got = [r.p for r in rows.select("i", named).select("i", F.expr(model.sql("x")).alias("p")).orderBy("i").collect()]
    raw = model.start + sum(pii.predict(t, x) for t in model.trees)
    assert np.allclose(got, 1 / (1 + np.exp(-(model.slope * raw + model.offset))))


def test_places_of_very_many_matches(spark, model):
    text = "call 555 123 4567 or +1 (212) 555-0143, 4111 1111 1111 1111, a@b.c. " * 1300
    start = time.time()
    r = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r.n_email == r.n_card == r.n_phone == 1300 and time.time() - start < 60
    want = [("phone", m.start(), m.end()) for m in re.finditer(r"\+1 \(212\) 555-0143", text)]
    assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))
    runs = "1 22 333 4444 55555 " * 40
    got = {(x.s, x.e) for x in pii.proposed(spark.createDataFrame([(runs,)], "text string"), "g", "phone").first().g}
    places = [(m.start(), m.end()) for m in re.finditer("[0-9]+", runs)]
    want = {(a, e) for i, (a, _) in enumerate(places) for j, (_, e) in enumerate(places[i:]) if 7 <= sum(y - x for x, y in places[i : i + j + 1]) <= 15}
    assert got == want


def test_no_documents_and_no_ids(spark, model):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(none, pii.train(none, planted_rows=200)).count() == 0
    assert pii.digest(spark.createDataFrame([(None, "a@b.c"), (None, "a@b.c")], "doc_id long, text string"), model).count() == 2
