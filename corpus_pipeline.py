"""The corpus pipeline: toxic documents go, boilerplate lines go, one document of each near-duplicate group stays, benchmark
passages go, and what remains is encoded. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelbase.llm import decontam, line_dedup, sentencepiece_codec, setjoin, toxicity
from reelbase.llm.common import cut, table
from reelbase.llm.queries import tokenizer


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The classifier learns from the labelled rows among ``docs``, a bounded sample of them."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more sources share stay in the first document that has them only. Emptied documents go."""
    return line_dedup.without_spread_lines(docs, min_sites=3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at 0.8 or more, directly or over others, the one with the smallest id stays."""
    return setjoin.deduplicated(docs, n=5, threshold=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item (or all of a shorter one) go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids of the whole text and whether decoding them gives the text back."""
    return sentencepiece_codec.encoded_and_checked(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxic_documents),
    ("line dedup", boilerplate_lines),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("sentencepiece", encoded),
]

#: SQL cannot express the classifier or the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
