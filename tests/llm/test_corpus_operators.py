"""Corpus operators against brute force, and the cases their docstrings state: nulls, empty and long texts, ties, repeated rows, empty tables."""

import base64
import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelbase.llm import decontam, fingerprints, line_dedup, pii, sentencepiece_codec, setjoin, token_counts, toxicity, url_filter, warc
from reelbase.llm.queries import tokenizer

LONG = "lorem ipsum dolor sit amet " * 3000
TEXTS = [None, "", "   ", "one", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "A b c d e f g h i j k L m", LONG, "x" * 5000, "é😀 ünï\ntwo\nthree", "tab\there <|endoftext|> don't"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)
    assert token_counts.token_counts(empty, path).count() == 0


def test_decontamination_with_blocks_equals_one_pass(spark, docs, empty):
    bench = spark.createDataFrame([(1, "b c d e f g h i j k"), (2, "one"), (3, None), (4, "lorem ipsum"), (5, "zz yy")], "item_id long, text string")
    one = {r.doc_id: tuple(r) for r in decontam.digest(docs, bench, 10).collect()}
    assert one[4][2:4] == (10, 1) and one[3][2:4] == (1, 1) and one[0][1:4] == (0, 0, 0) and one[7][2] == 6000
    many = {r.doc_id: (r.n_words, r.spans, r["items"]) for r in decontam.contamination(docs, bench, 10, block_bytes=40).collect()}
    single = {r.doc_id: (r.n_words, r.spans, r["items"]) for r in decontam.contamination(docs, bench, 10).collect()}
    assert many == single
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench).collect()) == [i for i in range(len(TEXTS)) if not single[i][1]]
    assert decontam.digest(empty, bench).count() == 0
    assert decontam.digest(docs, bench.limit(0)).where("contaminated").count() == 0
    longest = decontam.longest_matches(docs, bench).where("doc_id = 6").collect()
    assert [(r.item, r.item_start, r.doc_start, r.length) for r in longest] == [("1", 0, 1, 10)]


def test_sentencepiece_equals_the_library(docs, empty):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = sentencepiece_codec.encode(docs, path)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: lib.encode(t or "") for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(ids, path).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert sentencepiece_codec.digest(empty, path).count() == 0


def test_line_dedup(spark, empty):
    rows = [(0, "keep\nshared", "a"), (1, "shared \nown", "b"), (2, "shared", "c"), (3, None, "d"), (4, "two\ntwo", "a"), (5, "two", None), (5, "two", None)]
    got = sorted((r.doc_id, r.text, r.lines_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), 3).collect() if r.doc_id != 3)
    assert got == [(0, "keep\nshared", 0), (1, "own", 1), (2, "", 1), (4, "two\ntwo", 0), (5, "two", 0), (5, "two", 0)]
    assert line_dedup.line_dedup(empty).count() == 0


def test_fingerprints(docs, empty):
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = sorted(range(len(TEXTS)), reverse=True)
    for k, i in enumerate(order):
        t, nxt = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
    assert rows[4].fingerprint == rows[5].fingerprint != rows[7].fingerprint and rows[5].near_next == 1.0
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_fingerprint_collisions_estimate_generalised_jaccard(spark):
    a, b = "w1 " * 3 + "w2 w3 w4 w5 w6", "w1 " * 6 + "w2 w3 w7 w8 w9"
    x, y = Counter(a.split()), Counter(b.split())
    true = sum((x & y).values()) / sum((x | y).values())
    p = fingerprints.fingerprints(spark.createDataFrame([(0, a), (1, b)], "k int, t string"), ["k"], "t", samples=128).orderBy("k").collect()
    share = sum(p[0][1][8 * i : 8 * i + 8] == p[1][1][8 * i : 8 * i + 8] for i in range(128)) / 128
    assert abs(share - true) < 0.15


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "same"), (2, None, "same"), (3, "http://c", None), (4, "u\nv", "same"), (5, "", "é" * 100_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 4), 2: ("revisit", 4), 3: ("response", None), 4: ("response", None), 5: ("response", None)}
    assert got[5].payload_bytes == 200_000 and got[1].payload_digest == base64.b32encode(hashlib.sha1(b"same").digest()).decode()


def test_url_verdicts(spark):
    urls = [None, "nothing", "http://A.Net/x?y", "https://a.example.net/en/1#z", "http://example.com/de/9", "ftp://b.org/fr/", "http://notnet/", "http://a.net", "http://royalcasino.example.info/en/3", "http://museum.example.info/en/3"]
    got = {r.page_id: r for r in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(8)] == [("", "", None), ("", "", None), ("a.net", "/x", "net/"), ("a.example.net", "/en/1", "example.net/en/"), ("example.com", "/de/9", "example.com/de/"), ("b.org", "/fr/", "org/fr/"), ("notnet", "/", None), ("a.net", "", None)]
    assert [got[i].verdict for i in (2, 3, 4, 5, 8, 9)] == ["block", "allow", "block", "allow", "block", "allow"]


def test_toxicity_learns_words_and_scores_every_window(spark, empty):
    clean = "the of and to in is that for was on"
    rows = [(i, f"{clean} {'awfulword' if i % 3 == 0 else 'fine'} {clean} {i}") for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, f"{clean} " * 200 + "awfulword " + f"{clean} " * 200), (901, None), (902, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 3 == 0) for i in held) / len(held) > 0.95
    assert got[900].predicted == 1 and got[901].score == got[902].score and got[901].predicted == 0
    assert toxicity.toxicity(empty, model).count() == 0
    assert {r.doc_id for r in toxicity.without_toxic(docs, model).collect()} == {i for i, r in got.items() if not r.predicted}


def brute_components(texts, n, t):
    sets = {}
    for i, x in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= t * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_set_join_equals_brute_force(spark, empty):
    import random

    rng = random.Random(5)
    texts = list(TEXTS)
    for family in range(6):
        base = [f"w{family}_{k}" for k in range(rng.choice((8, 40, 120)))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n, t in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.ngram_jaccard_components(docs, n, t).collect()}
        assert got == brute_components(texts, n, t)
    assert setjoin.ngram_jaccard_components(empty, 4, 85).count() == 0


def test_personal_data(spark, empty):
    texts = ["a@b.c_d@e.f", "+1 (234) 567-8901 and 256.1.1.1 1.2.3.4.5.6.7.8", None, "", "é😀 4111 1111 1111 1111@x.y.z", "1" * 3000, "4111111111111112"]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), None).collect()}
    assert [got[i].spans for i in range(7)] == ["email:0:5,email:5:11", got[1].spans, "", "", "email:18:28,card:3:22", "", ""]
    assert got[1].n_phone == 1 and got[1].n_ip == 2
    assert pii.digest(empty, None).count() == 0
    shown = pii.redacted(spark.createDataFrame([(0, "mail a@b.c now")], "doc_id long, text string"), None).first().text
    assert shown == "mail [email] now"


def test_phone_generator_proposes_the_common_forms(spark):
    phones = ["(212) 555-1234", "212-555-1234", "0612345678", "06 12 34 56 78", "030 1234567", "030/12345678", "004930123456", "91 234 56 78", "1-800-555-1234", "+49 (0)30 123-456"]
    texts = [*(f"é😀 call {p}, then" for p in phones), "12 0612345678 5", "123456 x 1234567890123456", "1 " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {(x.m, x.s) for x in r.gen} for r in pii.proposed(docs, "gen", "phone").collect()}
    assert all((p, texts[i].index(p)) in got[i] for i, p in enumerate(phones))
    assert ("0612345678", 3) in got[10] and got[11] == set()
    assert {len(m) for m, _ in got[12]} == {2 * k - 1 for k in range(7, 16)}


def test_dropped_candidates_drop_no_other(spark):
    # nine digits beat eight, which beat seven; the middle part meets both others and goes, and the last one stays
    digits = pii.FEATURES.index("digits")
    model = pii.Trees([(digits, 7.5, 0.5, (digits, 8.5, 1.0, (digits, 9.5, 2.0, -5.0)))], 0.0, 1.0, 0.0, 0.5)
    r = pii.personal_data(spark.createDataFrame([(0, "1111 22222 333 4444")], "doc_id long, text string"), model).first()
    assert [(pii.KINDS[x.k], x.s, x.e) for x in r.spans] == [("phone", 0, 10), ("phone", 11, 19)]


def test_extra_columns_do_not_clash(docs):
    odd = docs.withColumn("id", F.lit(1)).withColumn("n", F.lit("x")).withColumn("spans", F.lit(0)).withColumn("score", F.lit(None).cast("string"))
    assert token_counts.token_counts(odd, tokenizer("byte_bpe_50k.json")).count() == len(TEXTS)
    assert setjoin.deduplicated(odd).columns == odd.columns
    assert line_dedup.without_spread_lines(odd).columns == odd.columns
