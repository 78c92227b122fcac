"""Empty tables give empty results, and no labels give a classifier that rejects nothing."""

import corpus_pipeline
from reelbase.llm import sentencepiece_codec, setjoin, toxicity, url_filter, warc
from reelbase.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_documents_and_pages(spark):
    docs = spark.createDataFrame([], DOCS)
    pages = spark.createDataFrame([], "page_id long, url string, html string, lang string")
    assert warc.round_trip(pages).count() == 0
    assert url_filter.url_verdicts(pages).count() == 0
    model = tokenizer("piece_bpe_32k.model")
    ids = sentencepiece_codec.encode(docs, model)
    assert ids.count() == 0 and sentencepiece_codec.decode(ids, model).count() == 0
    assert setjoin.deduplicated(docs).columns == docs.columns and setjoin.deduplicated(docs).count() == 0


def test_pipeline_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_labels_reject_nothing(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.without_toxic(docs, model).count() == 3
