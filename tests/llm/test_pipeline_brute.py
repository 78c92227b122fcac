"""The pipeline on a small table against a chain of plain versions of its stages."""

import os
import random

import corpus_pipeline
from reelbase.llm import toxicity
from reelbase.llm.queries import tokenizer
from tests.llm.test_corpus_operators import brute_components
from tests.llm.test_decontam_brute import brute as contamination


def lines_without_spread(docs):
    sites, first = {}, {}
    for i, (t, source) in docs.items():
        for line in (t or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(source or "")
                first[line.strip(" ")] = min(i, first.get(line.strip(" "), i))
    out = {}
    for i, (t, source) in docs.items():
        if t is None:
            out[i] = (t, source)
            continue
        kept = [x for x in t.split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < 3 or first[x.strip(" ")] == i]
        had = [x for x in t.split("\n") if x.strip(" ")]
        if not had or any(x.strip(" ") for x in kept):
            out[i] = ("\n".join(kept), source)
    return out


def test_run_equals_plain_stages(spark, tmp_path):
    import sentencepiece

    rng = random.Random(6)
    word = lambda k: f"{'abcdefgh'[k % 8]}word{k}"
    texts = []
    for family in range(12):
        base = [word(rng.randrange(400)) for _ in range(60)]
        for copy in range(4):
            w = list(base)
            if copy == 1:
                w[5] = "edited"
            if copy == 2:
                w = [word(rng.randrange(400)) for _ in range(40)]
            texts.append(" ".join(w) + (f"\nshared footer {family % 2}" if copy % 2 == 0 else ""))
    leak = "one two three four five six seven eight nine ten eleven"
    texts += [f"start {leak} end", None, "", "shared footer 0"]
    texts += [f"{'nasty' if i % 2 else 'plain'} talk number {i} of the day" for i in range(40)]
    rows = [(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    root = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int("nasty" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(os.path.join(root, f"{name}.parquet"))
    read = spark.read.parquet(f"{root}/documents.parquet")
    model = toxicity.train(read, labels)
    clean = {i: (t, s) for (i, t, _, s, _) in rows if toxicity.score_texts(model, [(t or "").lower().encode()])[0] < 0.5}
    assert any("nasty" in (t or "") for t in texts) and len(clean) < len(rows)
    kept = lines_without_spread(clean)
    order = sorted(kept)
    comp = brute_components([kept[i][0] for i in order], 5, 80)
    alone = [i for k, i in enumerate(order) if comp[k][1] == k]
    final = [i for i in alone if not contamination(kept[i][0], [(1, leak)], 10)[0][4]]
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    got = {r.doc_id: (list(r.ids), r.n_ids, r.round_trip) for r in corpus_pipeline.run(spark, root).collect()}
    want = {i: lib.encode(kept[i][0] or "") for i in final}
    assert got == {i: (x, len(x), True) for i, x in want.items()}
    assert len(final) < len(alone) < len(order) and len(kept) < len(clean)
