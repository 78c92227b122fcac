"""What is redacted does not depend on how the table is dealt to files and tasks."""

from reelbase.llm import pii


def test_trees_and_spans_are_the_same_for_three_layouts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    layouts = [docs, docs.repartition(7), docs.orderBy("text").coalesce(2)]
    settings = {"sample_rows": 120, "sample_candidates": 300, "planted_rows": 250}
    models = [pii.train(d, **settings) for d in layouts]
    assert models[0] is not None and all(m == models[0] for m in models)
    again = [sorted((r.doc_id, str(r.spans)) for r in pii.personal_data(d, models[0]).select("doc_id", "spans").collect()) for d in layouts[:2]]
    assert again[0] == again[1]
