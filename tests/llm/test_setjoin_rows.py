"""Repeated ids, null ids and repeated rows in the set join and the removal built on it."""

from reelbase.llm import setjoin

A = " ".join(f"a{i}" for i in range(60))
A2 = A.replace("a59", "zz")
B = " ".join(f"b{i}" for i in range(60))
B2 = B.replace("b0 ", "yy ")
C = "c1 c2 c3"


def docs(spark):
    rows = [(1, A, "x"), (1, B, "x"), (1, C, "x"), (2, A2, "x"), (3, B2, "x"), (3, B2, "y"), (None, A, "x"), (4, None, "x"), (4, "", "x"), (5, C, "x"), (5, C, "x"), (6, "only", "x"), (6, "only", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, _h string")


def test_each_text_of_a_repeated_id_links_on_its_own(spark):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.links) for r in setjoin.ngram_jaccard_components(docs(spark), 4, 85, count_links=True).collect())
    want = [("1", 57, "1", 1), ("1", 57, "1", 1), ("1", 1, "1", 0), ("2", 57, "1", 1), ("3", 57, "1", 1), ("3", 57, "1", 1), ("None", 57, "None", 0), ("4", 0, "4", 0), ("4", 0, "4", 0)]
    want += [("5", 1, "1", 0), ("5", 1, "1", 0), ("6", 1, "6", 0), ("6", 1, "6", 0)]
    assert got == sorted(want)


def test_one_row_of_each_component_stays(spark):
    out = setjoin.deduplicated(docs(spark), 4, 85)
    assert out.columns == ["doc_id", "text", "_h"]
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    # texts A, B and C of id 1 are three components; null ids and texts without words stay
    want = [("1", A), ("1", B), ("1", C), ("None", A), ("4", "None"), ("4", ""), ("6", "only")]
    assert got == sorted(want)
    assert setjoin.deduplicated(docs(spark).limit(0), 4, 85).count() == 0
