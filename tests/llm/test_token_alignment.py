"""Alignment against the two libraries on whole texts and plain loops over all tokens."""

from collections import Counter
from hashlib import sha256

import pytest

from reelbase.llm import token_alignment
from reelbase.llm.queries import QUERIES, tokenizer
from reelbase.llm.token_counts import byte_letters

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a", "  a", "end ", "a▁b", "▁", "x\n  y", "tab\t z", "\r\n \r\n", "<|endoftext|> a", "<s> </s> <unk> <0x0A>", "é̀ 日本語 テキスト", "a" * 3000, " " * 50 + "b"]
ODD += ["\x00 \x1c q", "  em  sp   x", "''s 's don't I'LL", "🙂🙃 👨‍👩‍👧", "a  b", "﻿ hi", "١٢٣ 12345 x²", "\x85   z"]


def whole(text):
    """Tokens and their bytes by the libraries, or nothing."""
    import sentencepiece
    from tokenizers import Tokenizer

    if "a" not in whole.__dict__:
        whole.a, whole.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        whole.a.encode_special_tokens = True
        whole.back = {c: i for i, c in enumerate(byte_letters())}
    if not text:
        return [], [], [], []
    a, b = whole.a.encode(" " + text, add_special_tokens=False).ids, whole.b.encode(text)
    x = [bytes(whole.back[c] for c in whole.a.id_to_token(i)) for i in a]
    y = [bytes([int(p[3:-1], 16)]) if whole.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(whole.b.id_to_piece, b), strict=True)]
    full = (" " + text).encode()
    return (a, b, x, y) if b"".join(x) == full == b"".join(y) else ([], [], [], [])


def aligned(text):
    """Groups as pairs of id lists, links as a counter of id pairs."""
    a, b, x, y = whole(text)
    spans = [[], []]
    for out, tokens in zip(spans, (x, y), strict=True):
        at = 0
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
    both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, lo = [], 0
    for hi in both:
        groups.append(([i for i, s in zip(a, spans[0], strict=True) if lo < s[1] <= hi], [i for i, s in zip(b, spans[1], strict=True) if lo < s[1] <= hi]))
        lo = hi
    links = Counter((a[i], b[j]) for i, s in enumerate(spans[0]) for j, t in enumerate(spans[1]) if s[0] < t[1] and t[0] < s[1])
    return groups, links


def plain(rows):
    per = [(i, *aligned(t)) for i, t in rows]
    holds = Counter(p for _, _, links in per for p in links)
    most = {}
    for (a, _), n in holds.items():
        most[a] = max(n, most.get(a, 0))
    for i, groups, links in per:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n for p, n in links.items() if holds[p] == most[p[0]])
        yield (i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), links.total(), best, sum(n * holds[p] for p, n in links.items()), sha256(shown.encode()).hexdigest() if groups else "")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def rows():
    import duckdb

    real = duckdb.sql("select doc_id, left(text, 900) from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit 60").fetchall()
    return [*real, *((1000 + k, t) for k, t in enumerate(ODD)), real[3], (None, "no id"), (None, "no id"), (1000, "again")]


@pytest.mark.parametrize("most_sent", [400_000, 300, 0])
def test_digest_against_plain_loops(spark, rows, most_sent):
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, row int, a string").repartition(3)
    got = token_alignment.digest(docs, A, B, most_sent=most_sent)
    assert got.columns == COLUMNS
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_alignments_give_the_groups(spark, rows):
    texts = [t for _, t in rows]
    for r in token_alignment.alignments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).collect():
        groups = [(r.a_ids[a:c], r.b_ids[b:d]) for a, b, c, d in zip([0, *r.a_ends], [0, *r.b_ends], r.a_ends, r.b_ends)]
        assert groups == aligned(texts[r.doc_id])[0]


def test_long_texts_go_through_in_stretches_and_with_a_small_memo(rows):
    text = " ".join(t for _, t in rows if t and "▁" not in t)
    al = token_alignment.Aligner(token_alignment.load(A, B), memo_chars=500, stretch=700)
    texts = [text, "bad▁one " + text, "", text[:5000], text + " bad▁end"]
    got = token_alignment.digests(al, texts)
    one = aligned(text[:5000])
    assert [d.n_a > 0 for d in got] == [True, False, False, True, False]
    assert (got[3].n_groups, got[3].n_links) == (len(one[0]), one[1].total())
    a, b, _, _ = whole(text)
    assert (got[0].n_a, got[0].n_b) == (len(a), len(b))
    large = token_alignment.digests(token_alignment.Aligner(token_alignment.load(A, B)), texts)
    assert [(d.n_links, d.sha and d.sha.hexdigest(), d.pairs.tolist(), d.times.tolist()) for d in large] == [(d.n_links, d.sha and d.sha.hexdigest(), d.pairs.tolist(), d.times.tolist()) for d in got]


def test_runs_equal_a_merge_of_all_ends():
    import random

    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 120)
        share = rng.random()
        a = sorted({n, *(x for x in range(1, n) if rng.random() < 0.6)})
        b = sorted({n, *(x for x in a if rng.random() < share), *(x for x in range(1, n) if rng.random() < 0.2)})
        straight, groups, links = token_alignment.runs(a, b)
        ends = {a[s + k] for s, _, size in zip(*[iter(straight)] * 3, strict=True) for k in range(size)} | {a[i - 1] for i, _ in zip(*[iter(groups)] * 2, strict=True)}
        assert ends == set(a) & set(b)
        every = sorted([*zip(*[iter(links)] * 2, strict=True), *((s + k, t + k) for s, t, size in zip(*[iter(straight)] * 3, strict=True) for k in range(size))])
        spans = [list(zip([0, *x], x)) for x in (a, b)]
        assert every == [(i, j) for i, s in enumerate(spans[0]) for j, t in enumerate(spans[1]) if s[0] < t[1] and t[0] < s[1]]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_token_alignment"](spark, str(tmp_path))
    assert got.columns == COLUMNS and got.count() == 0
