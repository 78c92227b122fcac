"""Decontamination gives the same rows however many blocks the benchmark fills."""

import itertools

from reelbase.llm import decontam

LEAK = "a b c d e f g h i j"
OTHER = "k l m n o p q r s t"


def test_rows_do_not_depend_on_the_number_of_blocks(spark):
    rows = [(1, f"x {LEAK} y"), (1, f"x {LEAK} y"), (1, f"{OTHER} z"), (None, LEAK), (None, "nothing"), (None, None), (2, f"{LEAK} {OTHER}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("i", LEAK), ("i", f"{LEAK} v"), ("j", OTHER), (None, OTHER)], "item_id string, text string")
    want = sorted([("1", 12, [1, 11], ["i"]), ("1", 12, [1, 11], ["i"]), ("1", 11, [0, 10], ["j", "null"]), ("None", 10, [0, 10], ["i"]), ("None", 1, [], []), ("None", 0, [], []), ("2", 20, [0, 20], ["i", "j", "null"])])
    for size in (8 << 20, 60):
        got = decontam.contamination(docs, bench, 10, block_bytes=size).collect()
        assert sorted((str(r.doc_id), r.n_words, r.spans, r["items"]) for r in got) == want


def test_blocks_come_one_at_a_time(spark):
    bench = spark.createDataFrame([(i, f"w{i} " * 10) for i in range(40)], "item_id long, text string")
    n, parts = decontam.blocks(bench, "item_id", "text", 200)
    assert n > 5 and not isinstance(parts, list)
    assert sorted(int(i) for i, _ in itertools.chain.from_iterable(parts)) == list(range(40))
