"""The link count of the set join against brute force."""

import random

from reelbase.llm import setjoin


def test_links_count_every_pair_of_a_large_group(spark):
    rng = random.Random(8)
    texts = []
    for family in range(3):
        base = [f"w{family}_{k}" for k in range(60)]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            texts.append(" ".join(w))
    texts += [None, "", "alone here"]
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if (w := (x or "").split()) else frozenset() for x in texts]
    links = {s: sum(o != s and bool(o) and 100 * len(s & o) >= 85 * len(s | o) for o in set(sets)) for s in set(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.links for r in setjoin.ngram_jaccard_components(docs, 4, 85, count_links=True).collect()}
    assert max(links.values()) > 12 and got == {i: links[s] if s else 0 for i, s in enumerate(sets)}
    assert "links" not in setjoin.ngram_jaccard_components(docs.limit(0), 4, 85).columns
