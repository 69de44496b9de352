"""A corpus pipeline: each stage works on what the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontaminate, line_dedup, quality, sentencepiece, simhash
from parlance.llm.common import Scratch, released


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely junk or toxic than good; the model is fitted to labelled ones."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that stood earlier in the corpus from every document; one that has no other lines is dropped."""
    return line_dedup.drop_repeated_lines(docs, length_col="n_chars", keep_emptied=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group whose five-word shingles are alike to 0.8."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document, with its language and source."""
    return sentencepiece.encode(docs, keep=("lang", "source", "n_chars"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", tokenize),
]

#: SimHash prints, fitted weights and sampled pieces have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared folder before the next one.

    What a stage has written on its way, and the documents that it read, are
    deleted when its result is written.
    """
    scratch, before = Scratch(spark), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with released():
            docs = scratch.table(stage(spark, docs, sf_dir))
        scratch.drop(*before)
        before = [docs]
    return docs
