"""Contamination, longest matches and removal against brute force."""

import hashlib
import random
import re

from reelbase.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window):
    w = words(text)
    hit, ids, best = set(), set(), {}
    for i, t in items:
        q = words(t)
        m = min(window, len(q))
        for s in range(len(q) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == q[s : s + m]:
                    n = m
                    while s + n < len(q) and p + n < len(w) and q[s + n] == w[p + n]:
                        n += 1
                    hit.update(range(p, p + m))
                    ids.add(str(i))
                    best[p] = max(best.get(p, 0), n)
    own = ",".join(sorted(ids))
    longest = max(best.values(), default=0)
    at = min((p for p, n in best.items() if n == longest), default=-1)
    maximal = {(p, n) for p, n in best.items() if best.get(p - 1) != n + 1}
    return (len(w), len(hit), len(ids), hashlib.sha256(own.encode()).hexdigest(), bool(hit), longest, at), maximal


def corpus():
    rng = random.Random(4)
    letters = "abc"
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice((0, 2, 4, 9, 30))))) for i in range(14)]
    items += [(50, None), (51, "é ü é ü é"), (51, "Q R S T"), (52, "a a a a a a a a a a a a")]
    texts = [" ".join(rng.choice(letters + "d") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [f"zz {t} yy {t}" for _, t in items if t] + [None, "", "...", "É ü é ü é", "x " * 3000 + "q r s t " + "a " * 40]
    return items, texts


def test_query_and_matches_equal_brute_force(spark):
    items, texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute(t, items, 5) for i, t in enumerate(texts)}
    got = {r.doc_id: tuple(r)[1:] for r in decontam.digest(docs, bench, 5).collect()}
    assert got == {i: w for i, (w, _) in want.items()}
    for size in (8 << 20, 60):
        c = {r.doc_id: (r.n_words, r.longest, r.longest_at) for r in decontam.contamination(docs, bench, 5, block_bytes=size).collect()}
        assert c == {i: (w[0], w[5], w[6]) for i, (w, _) in want.items()}
    found = decontam.longest_matches(docs, bench, 5).collect()
    assert len(found) == len({(r.doc_id, r.doc_start) for r in found})
    places = {}
    for r in found:
        places.setdefault(r.doc_id, set()).add((r.doc_start, r.length))
        w = words(texts[r.doc_id])
        assert any(str(i) == r.item and words(t)[r.item_start : r.item_start + r.length] == w[r.doc_start : r.doc_start + r.length] for i, t in items)
    assert places == {i: m for i, (_, m) in want.items() if m}
    for size in (8 << 20, 60):
        kept = sorted(r.doc_id for r in decontam.decontaminate(docs, bench, 5, block_bytes=size).collect())
        assert kept == [i for i, (w, _) in want.items() if not w[4]]


def test_removal_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine", 2), (2, "x", None, None)], "doc_id long, text string, __words_of string, row int")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [tuple(r) for r in decontam.decontaminate(docs, bench).collect()] == [(2, "x", None, None)]
    assert decontam.decontaminate(docs.limit(0), bench.limit(0)).columns == docs.columns
